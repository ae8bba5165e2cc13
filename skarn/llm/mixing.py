"""Mixing sources to target weights.

The budget is divided into equal blocks of tokens. Sainte-Lague apportionment gives every block to the source with the
highest quotient, as long as its texts, repeated up to their cap, can fill one or a part of one; what a source can't fill
goes to the others. A source's quota is its blocks' tokens, its last block cut to what its texts can give. The source's
texts are laid out in seeded order, shard after shard, each shard beginning where the one before ends, and are used round
after round until the quota is full. So a shard may be of any size beside a block, and only a shard is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.tokens import TOKENIZER, token_counter
from skarn.llm.sampling import seats_by_priority
from skarn.llm.text import hash60
from skarn.session import cut

#: Blocks that the budget is divided into at least, and tokens that a shard holds at most on average.
BLOCKS, SHARD_TOKENS = 10_000, 20_000_000


def count_tokens(docs: DataFrame, doc_id: str, source: Column, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, source, tokens, copy (a digest of the text; null without one). Null texts have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = token_counter(tokenizer)
        for b in batches:
            yield b.assign(tokens=[n(x) if x else 0 for x in b["text"]])[["id", "source", "tokens", "copy"]]

    rows = docs.select(F.col(doc_id).alias("id"), source.alias("source"), F.col(text).alias("text"), F.md5(F.col(text)).alias("copy"))
    return rows.mapInPandas(count, f"id {dict(rows.dtypes)['id']}, source string, tokens long, copy string")


def mix_sources(counted: DataFrame, targets: DataFrame, budget: int | None = None, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``counted``: what count_tokens gives. ``targets``: source, target_share, max_repeats, one row per source. The
    budget is by default the tokens of all documents. selection: id, source, tokens, repeats (1 to the cap). Texts that
    stand under several ids are one text, used under the least id of the sources asked for, so that no text is used
    more often than its source's cap. report, per target: source, target_share, max_repeats, tokens (all its
    documents), wanted (target_share of all tokens), blocks (the last may be part full), quota (their tokens), reached_tokens (the quota and
    less than one text more), reached_share, short (tokens x max_repeats < wanted). Rows with a null id, without tokens or of other sources are never selected, but their
    tokens count in the total. Null shares and caps count as 0. Without tokens or targets nothing is selected.
    """
    counted = cut(counted)
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    size = max(1, budget // blocks)
    shards = max(1, -(-total // shard_tokens))
    of_source = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    texts = (
        counted.where("id is not null and tokens > 0").join(t.select("source"), "source", "left_semi")
        .groupBy("copy").agg(F.min(F.struct("id", "source", "tokens")).alias("x")).select("x.*")
        .withColumn("shard", hash60("id", seed) % F.lit(shards))
    )
    texts = cut(texts)
    in_shard = cut(texts.groupBy("source", "shard").agg(F.sum("tokens").alias("shard_tokens")))
    usable = in_shard.groupBy("source").agg(F.sum("shard_tokens").alias("usable"))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        room = [u * max(0, r) for u, r in zip(pdf["usable"].tolist(), pdf["max_repeats"].tolist())]
        n = budget // size
        for _ in range(len(pdf) + 1):  # the tokens that part-full last blocks lack go to the others, as whole blocks
            blocks = seats_by_priority([-(-x // size) for x in room], pdf["target_share"].tolist(), [0] * len(pdf), n)
            n = budget // size + sum(b * size - min(b * size, x) for b, x in zip(blocks, room)) // size
        return pdf.assign(blocks=blocks, quota=[min(b * size, x) for b, x in zip(blocks, room)]).drop(columns="all")

    per_source = t.join(usable, "source", "left").withColumns({"usable": F.coalesce("usable", F.lit(0)), "all": F.lit(0)})
    quota = cut(per_source.groupBy("all").applyInPandas(apportion, "source string, target_share double, max_repeats int, usable long, blocks long, quota long"))

    # a row per shard, and a shard per 20 million tokens
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_shard.select("source", "shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("start")).join(quota.select("source", "max_repeats", "usable", "quota"), "source")
    w = Window.partitionBy("source", "shard").orderBy(hash60("id", seed + 1), "id").rowsBetween(Window.unboundedPreceding, -1)
    laid = texts.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(starts, ["source", "shard"])
    # copy r of a text begins at start + before + r x usable of its source; it is used if that lies in the quota
    copies = F.expr("(quota - start - before + usable - 1) div usable")
    chosen = laid.withColumn("repeats", F.least("max_repeats", F.greatest(copies, F.lit(0))).cast("int")).where("repeats > 0").select("id", "source", "tokens", "repeats")
    chosen = cut(chosen)
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"))
    everything = Window.partitionBy(F.lit(0))  # a row per target
    report = (
        quota.drop("usable").join(of_source, "source", "left").join(reached, "source", "left")
        .withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "reached_tokens": F.coalesce("reached_tokens", F.lit(0)), "wanted": F.col("target_share") * F.lit(total)})
        .withColumns({"reached_share": F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(everything), F.lit(0)), "short": F.col("tokens") * F.col("max_repeats") < F.col("wanted")})
    )
    return chosen, report
