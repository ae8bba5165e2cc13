"""Text, JSON and prediction-parsing expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_THINK = "(?s)<think>(.*?)</think>"


def squashed(c: Column) -> Column:
    """Lower case, white space runs as one space, none outside."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def sha1_text(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def signature(*parts: Column) -> Column:
    """A digest of squashed parts; null parts count as empty but keep their place."""
    return sha1_text(F.concat_ws("\x1f", *[F.coalesce(squashed(p.cast("string")), F.lit("")) for p in parts]))


def struct_signature(*cs: Column) -> Column:
    """A digest of a record's canonical JSON: fields in the order given, nulls written out."""
    return sha1_text(F.to_json(F.struct(*cs), {"ignoreNullFields": "false"}))


def json_signature(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """A digest of every leaf of a JSON object but those dropped ('event.event_id'), whatever the order of its keys.

    Objects are opened at two levels; deeper ones count as their text. Numbers, also those written as text, are equal by
    value, and a null differs from an absent leaf. Null for what isn't a JSON object.
    """
    path = lambda *ks: F.concat(F.lit("$"), *[x for k in ks for x in (F.lit("['"), k, F.lit("']"))])
    get = lambda *ks: F.call_function("get_json_object", c, path(*ks))
    value = lambda x: F.coalesce(x.try_cast("double").cast("string"), x, F.lit("\x00"))

    def section(k: Column) -> Column:
        inner = F.array_sort(F.json_object_keys(get(k)))
        kept = F.filter(inner, lambda j: ~F.concat(k, F.lit("."), j).isin(list(drop))) if drop else inner
        leaf = F.filter(F.array(k), lambda x: ~x.isin(list(drop))) if drop else F.array(k)
        one = F.transform(leaf, lambda x: F.concat(x, F.lit("="), value(get(x))))
        return F.when(inner.isNull(), one).otherwise(F.transform(kept, lambda j: F.concat(k, F.lit("."), j, F.lit("="), value(get(k, j)))))

    return sha1_text(F.array_join(F.flatten(F.transform(F.array_sort(F.json_object_keys(c)), section)), "\x1f"))


def mentions_any(c: Column, needles: list[str]) -> Column:
    """Whether a text holds one of several strings; null for null text."""
    out = F.contains(c, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(c, F.lit(n))
    return out


def json_template(c: Column) -> Column:
    """The sorted top-level keys of a JSON object, joined by commas; null if it isn't one."""
    return F.array_join(F.array_sort(F.json_object_keys(c)), ",")


def think_parts(c: Column) -> dict[str, Column]:
    """Columns describing <think> blocks: contains_think, think_text, malformed, stripped, has_answer, json_after_text.

    Only the first block is cut out. Null text gives nulls.
    """
    opened, closed = F.regexp_count(c, F.lit("<think>")), F.regexp_count(c, F.lit("</think>"))
    has = c.rlike(_THINK)
    stripped = F.regexp_replace(F.when(has, F.regexp_replace(c, r"(?s)^(.*?)<think>.*?</think>", "$1")).otherwise(c), r"^\s+|\s+$", "")
    brace = F.instr(stripped, "{")
    return {
        "contains_think": (opened > 0) | (closed > 0),
        "think_text": F.when(has, F.regexp_extract(c, _THINK, 1)),
        "malformed": (opened != closed) | (opened > 1) | (closed > 1) | (~has & ((opened > 0) | (closed > 0))),
        "stripped": stripped,
        "has_answer": F.length(stripped) > 0,
        "json_after_text": (brace > 1) & (F.length(F.trim(F.substring(stripped, F.lit(1), brace - 1))) > 0),
    }


def label_in_text(c: Column) -> Column:
    """The first of positive, negative, neutral, yes, no (the last two as words) that the text holds, in that order of rank."""
    t = F.lower(c)
    return F.when(F.contains(t, F.lit("positive")), "positive").when(F.contains(t, F.lit("negative")), "negative").when(F.contains(t, F.lit("neutral")), "neutral").when(t.rlike(r"\byes\b"), "yes").when(t.rlike(r"\bno\b"), "no")


def json_blob(c: Column) -> Column:
    """The JSON object a text is, or holds from its first '{' to its last '}'; null otherwise. The result is text."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    a, back = F.instr(t, "{"), F.instr(F.reverse(t), "}")
    b = F.length(t) - back + 1
    inner = F.when((a > 0) & (back > 0) & (b > a), F.substring(t, a, b - a + 1))
    is_object = lambda x: F.json_object_keys(x).isNotNull() & x.startswith("{")
    return F.when(is_object(t), t).when(is_object(inner), inner)


def structured_field(blob: Column, text: Column, key: str, aliases: tuple[str, ...] = (), pattern: str | None = None) -> Column:
    """A field of the recovered object under its name or an alias, else what ``pattern`` finds in the text, in lower case."""
    found = F.coalesce(*[F.get_json_object(blob, f"$.{k}") for k in (key, *aliases)])
    return F.coalesce(found, F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))) if pattern else found


def excerpt(c: Column, n: int) -> dict[str, Column]:
    return {"text_excerpt": F.substring(c, 1, n), "text_truncated": F.length(c) > n, "text_length_chars": F.length(c)}


def chat_text(messages: Column) -> Column:
    """Messages in the im_start/im_end layout."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def templated(template: Column, fields: dict[str, Column]) -> Column:
    """A template with every {name} replaced by its field; a null field leaves nothing."""
    for k, c in fields.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return template


def score_label(c: Column, edge: float = 0.1) -> Column:
    return F.when(c < -edge, "negative").when(c < edge, "neutral").when(c.isNotNull(), "positive")
