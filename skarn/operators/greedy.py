"""Greedy samples under several caps at once.

Rows are taken in a given order; a row is taken if none of its keys has reached its cap. Whether it is depends on the
rows before it, so the pass is sequential, but a row can only be refused through a key that is full. So the driver
takes bounded chunks of narrow rows in order, and before each next chunk the rows of full keys are filtered out in
Spark. Every chunk therefore either takes rows or fills keys; the driver holds one chunk and the keys taken.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.session import cut, release

#: Narrow rows held by the driver at once.
CHUNK_ROWS = 50_000


@dataclass(frozen=True)
class Cap:
    """At most ``most`` rows (a number, or one per value of the key) for each value of ``key``; null keys count as one."""

    name: str
    key: Column
    most: int | dict[str, int]

    def limit(self, value: str) -> int:
        return self.most if isinstance(self.most, int) else self.most.get(value, 0)


def _pass(df: DataFrame, order: str, caps: dict[int, Cap], total: int, taken: dict[str, None], counts: dict[str, Counter], chunk: int) -> None:
    rows = df.select("id", *[f"k{i}" for i in caps], F.struct(order, "id").alias("at"))
    fields = rows.schema["at"].dataType
    last = None
    while len(taken) < total:
        left = rows
        if last is not None:
            left = left.where(F.col("at") > last)
        for i, c in caps.items():
            full = [(v,) for v, n in counts[c.name].items() if n >= c.limit(v)]  # no more than rows taken
            if full:
                left = left.join(df.sparkSession.createDataFrame(full, f"k{i} string"), f"k{i}", "left_anti")
        got = left.orderBy("at").limit(chunk).collect()
        for r in got:
            if r["id"] not in taken and all(counts[c.name][r[f"k{i}"]] < c.limit(r[f"k{i}"]) for i, c in caps.items()):
                taken[r["id"]] = None
                for i, c in caps.items():
                    counts[c.name][r[f"k{i}"]] += 1
                if len(taken) >= total:
                    return
        if len(got) < chunk:
            return
        at = got[-1]["at"]
        by = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(at[order], fields[order].dataType.fields)])
        last = F.struct(by.alias(order), F.lit(at["id"]).alias("id"))


def greedy_sample(df: DataFrame, record_id: str, order: list[Column], caps: list[Cap], total: int, backfill: list[Column] | None = None, unique: Column | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """record id, pick_order (1, 2, ...): at most ``total`` rows.

    ``unique``: a signature of which one row may be taken, also when backfilling. ``backfill``: an order in which rows
    are added regardless of caps if the total isn't reached. Order columns must not be null; ids must be unique strings
    (rows with a null id are ignored). The sample itself, ids and keys, is held by the driver.
    """
    sig = [Cap("unique", unique, 1)] if unique is not None else []
    every = [*caps, *sig]
    x = df.where(F.col(record_id).isNotNull()).select(
        F.col(record_id).cast("string").alias("id"), *[F.coalesce(c.key.cast("string"), F.lit("UNK")).alias(f"k{i}") for i, c in enumerate(every)],
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("by"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(backfill or order)]).alias("then"),
    )
    x = cut(x)  # narrow, and read once per chunk
    taken: dict[str, None] = {}
    counts: dict[str, Counter] = {c.name: Counter() for c in [*caps, *sig]}
    _pass(x, "by", dict(enumerate(every)), total, taken, counts, chunk)
    if backfill and len(taken) < total:
        _pass(x, "then", {len(caps): sig[0]} if sig else {}, total, taken, counts, chunk)
    release(x)
    return df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(taken, 1)], f"{record_id} string, pick_order int")
