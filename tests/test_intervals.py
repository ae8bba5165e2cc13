import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skarn.operators.intervals import DAY_BITS, Fold, coalesced, merged, periods_and_gaps

D0 = date(2021, 1, 1)
S = "k string, a date, b date, kind int, first_day int"


def run(spark, data):
    df = spark.createDataFrame(data, S).repartition(3)
    return sorted(tuple(r) for r in periods_and_gaps(df, F.col("k"), F.col("a"), F.col("b"), fan_in=2).collect())


def brute(data):
    out = []
    for k in {r[0] for r in data if r[0]}:
        days = {a + timedelta(days=i) for kk, a, b, *_ in data if kk == k and a and b for i in range((b - a).days + 1)}
        if not days:
            continue
        x, last = min(days), max(days)
        first, inside = x, True
        while x <= last:
            y = x + timedelta(days=1)
            if (y in days) != inside or y > last:
                out.append((k, "period" if inside else "gap", first, x))
                first, inside = y, not inside
            x = y
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    data = []
    for _ in range(200):
        a = D0 + timedelta(days=rnd.randrange(400))
        data.append((rnd.choice(["x", "x", "y", "z", None]), a if rnd.random() < 0.9 else None, a + timedelta(days=rnd.randrange(-3, 6)), 1, 2))
    assert run(spark, data + data[:30]) == brute(data)


def test_touching_nested_and_open(spark):
    d = lambda n: D0 + timedelta(days=n)
    end = date(9999, 12, 31)
    data = [("a", d(0), d(4), 0, 0), ("a", d(5), d(9), 0, 0), ("a", d(6), d(7), 0, 0), ("a", d(20), end, 0, 0), ("b", d(3), d(3), 0, 0), ("c", d(3), d(2), 0, 0)]
    assert run(spark, data) == [("a", "gap", d(10), d(19)), ("a", "period", d(0), d(9)), ("a", "period", d(20), end), ("b", "period", d(3), d(3))]


def test_empty(spark):
    assert run(spark, []) == []


def test_merge_is_associative():
    """States of parts, merged in any order, are the state of the whole."""
    rnd = np.random.default_rng(1)
    c, s = rnd.integers(0, 3, 300), rnd.integers(0, 2000, 300)
    e = s + rnd.integers(0, 9, 300)

    def state(i: slice) -> tuple[np.ndarray, np.ndarray]:
        at = (c[i] << DAY_BITS) + s[i]
        o = np.argsort(at, kind="stable")
        return coalesced(at[o], e[i][o])

    whole = state(slice(None))
    a, b, d = (state(slice(i, None, 3)) for i in range(3))
    for again in (merged(merged(a, b), d), merged(a, merged(b, d)), merged(d, merged(b, a))):
        assert all((x == y).all() for x, y in zip(whole, again))
    assert len(merged(a, (a[0][:0], a[1][:0]))[0]) == len(a[0])


def test_a_fold_merges_like_sized_states():
    fold = Fold()
    for i in range(64):
        fold.add(pd.DataFrame({"k": [f"k{i % 5}"], "starts": [[10 * i]], "ends": [[10 * i + 3]]}))
    assert len(fold.tree) < 8
    got = {r.k: (list(r.starts), list(r.ends)) for r in fold.result().itertuples()}
    assert got == {f"k{m}": ([10 * i for i in range(m, 64, 5)], [10 * i + 3 for i in range(m, 64, 5)]) for m in range(5)} and len(Fold().result()) == 0
