"""Overlapping and gapped time intervals.

The aggregate's state is, per entity, a sorted list of disjoint intervals that neither overlap nor touch. Two states
combine by a linear merge (``merged``), in any order, so the reduction runs as a tree: each input partition folds its own rows
first (no shuffle), partial lists of an entity meet under a salt, and only then under the entity alone. Days bound a
list: disjoint intervals that don't touch are at most half the days of the calendar, so no list grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "k string, starts array<int>, ends array<int>"

#: A state: position of the key and first day in one number, last day; sorted, disjoint.
State = tuple[np.ndarray, np.ndarray]
#: Bits of a day, counted from 0001-01-01.
DAY_BITS, DAY_ZERO = 34, 1 << 20


def coalesced(at: np.ndarray, end: np.ndarray, touch: int = 1) -> State:
    """Sorted intervals made disjoint; those at most ``touch`` apart become one."""
    if not len(at):
        return at, end
    base = at >> DAY_BITS << DAY_BITS
    reach = np.maximum.accumulate(end + base)  # a later key begins above every earlier end
    first = np.flatnonzero(np.r_[True, at[1:] > reach[:-1] + touch])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], (reach - base)[last]


def merged(a: State, b: State) -> State:
    """Two states as one. A stable sort of two sorted runs is one linear merge."""
    at, end = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    o = np.argsort(at, kind="stable")
    return coalesced(at[o], end[o])


class Fold:
    """A reduction tree of states: states of about the same size are merged, so every interval is moved a logarithmic number of times."""

    def __init__(self) -> None:
        self.keys: dict[str, int] = {}
        self.tree: list[State] = []

    def add(self, frame: pd.DataFrame) -> None:
        n = frame["starts"].map(len).to_numpy()
        code = np.repeat([self.keys.setdefault(k, len(self.keys)) for k in frame["k"]], n).astype(np.int64)
        start = np.concatenate([*frame["starts"], np.zeros(0, np.int64)]).astype(np.int64) + DAY_ZERO
        end = np.concatenate([*frame["ends"], np.zeros(0, np.int64)]).astype(np.int64) + DAY_ZERO
        at = (code << DAY_BITS) + start
        o = np.argsort(at, kind="stable")  # lists that come sorted are merged, single intervals sorted
        self.tree.append(coalesced(at[o], end[o]))
        while len(self.tree) > 1 and len(self.tree[-1][0]) * 2 >= len(self.tree[-2][0]):
            self.tree.append(merged(self.tree.pop(), self.tree.pop()))

    def result(self) -> pd.DataFrame:
        while len(self.tree) > 1:
            self.tree.append(merged(self.tree.pop(), self.tree.pop()))
        at, end = self.tree[0] if self.tree else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        code, start = at >> DAY_BITS, (at & ((1 << DAY_BITS) - 1)) - DAY_ZERO
        cut = np.flatnonzero(np.diff(code)) + 1
        names = np.array([*self.keys], object)
        lists = lambda x: [y.astype(np.int32) for y in np.split(x, cut)] if len(x) else []
        return pd.DataFrame({"k": names[code[np.r_[0, cut]]] if len(at) else [], "starts": lists(start), "ends": lists(end - DAY_ZERO)})


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fold = Fold()
    for b in batches:
        if len(b):
            fold.add(b)
    if fold.tree:
        yield fold.result()


def interval_states(df: DataFrame, key: Column, first: Column, last: Column, fan_in: int = 16) -> DataFrame:
    """One row per key: k, starts, ends (day numbers of the merged, sorted, disjoint periods).

    Rows with a null key or end, and those that end before they start, are ignored.
    """
    rows = df.select(key.cast("string").alias("k"), F.unix_date(first).alias("s"), F.unix_date(last).alias("e")).where("k is not null and s <= e")
    part = rows.select("k", F.array("s").alias("starts"), F.array("e").alias("ends")).mapInPandas(_fold, STATE)
    salted = part.withColumn("salt", F.spark_partition_id() % fan_in).repartition("k", "salt").drop("salt")
    return salted.mapInPandas(_fold, STATE).repartition("k").mapInPandas(_fold, STATE)


def periods_and_gaps(df: DataFrame, key: Column, first: Column, last: Column, fan_in: int = 16) -> DataFrame:
    """key, kind ('period' or 'gap'), first_day, last_day (DATE), both days inside the interval.

    Intervals of a key that overlap or follow on the next day are one period; a gap is the days between two
    periods; nothing lies before the first or after the last. Null keys or days and reversed intervals are ignored,
    repeated rows change nothing, an empty input gives no rows. Other columns are dropped, whatever their names.
    """
    return (
        interval_states(df, key, first, last, fan_in)
        .selectExpr(
            "k as key",
            """inline(concat(
                 transform(starts, (s, i) -> struct('period' as kind, s as f, ends[i] as l)),
                 transform(slice(starts, 2, size(starts)), (s, i) -> struct('gap' as kind, ends[i] + 1 as f, s - 1 as l))))""",
        )
        .select("key", "kind", F.date_from_unix_date("f").alias("first_day"), F.date_from_unix_date("l").alias("last_day"))
    )
