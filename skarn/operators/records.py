"""Training records: rendering, validation and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_json(groups: dict[str, Column | dict[str, Column]]) -> Column:
    """A JSON object with nested objects, keys sorted at both levels and nulls written out."""
    part = lambda g: F.struct(*[g[k].alias(k) for k in sorted(g)]) if isinstance(g, dict) else g
    return F.to_json(F.struct(*[part(groups[k]).alias(k) for k in sorted(groups)]), {"ignoreNullFields": "false"})


def instruct_record(df: DataFrame, instruction: str, inputs: dict, outputs: dict[str, Column], carry: list[Column]) -> DataFrame:
    """instruction, input, output (JSON text) and carried columns."""
    return df.select(F.lit(instruction).alias("instruction"), nested_json(inputs).alias("input"), nested_json(outputs).alias("output"), *carry)


def chat_record(df: DataFrame, system: str, user: Column, assistant: Column, carry: list[Column]) -> DataFrame:
    """messages (array of role and content) and carried columns."""
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return df.select(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant)).alias("messages"), *carry)


def conversation_messages(df: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """key and its turns in order as an array of (role, content)."""
    m = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return df.groupBy(key).agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def record_errors(df: DataFrame, record_id: str, input_: Column, output: Column, messages: Column, required: list[str]) -> DataFrame:
    """record id, error: a row per fault: empty input, no assistant turn, output mismatch, invalid JSON, missing keys.

    As soon as the assistant turn is absent or not JSON, later checks of the record don't apply.
    """
    last = F.when(F.size(messages) > 0, F.element_at(messages, -1))
    answer = F.when(last["role"] == "assistant", last["content"])
    keys = F.json_object_keys(answer)
    missing = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), k))
    faults = F.array_compact(F.array(
        F.when(F.coalesce(F.trim(input_), F.lit("")) == "", "empty input"),
        F.when(answer.isNull(), "missing assistant message"),
        F.when(answer.isNotNull() & ~answer.eqNullSafe(F.coalesce(output, F.lit(""))), "output mismatch"),
        F.when(answer.isNotNull() & keys.isNull(), "invalid json"),
        F.when(keys.isNotNull() & (F.size(missing) > 0), F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
    ))
    return df.select(F.col(record_id), F.explode(faults).alias("error"))


def require_valid(errors: DataFrame, limit: int = 5) -> None:
    """Raise if there is any error; a gate before a next stage."""
    found = errors.limit(limit).collect()
    if found:
        raise ValueError("invalid records: " + "; ".join(map(str, map(tuple, found))))
