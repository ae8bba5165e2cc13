"""Splits, samples and nearest times."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm.components import connected_components
from skarn.llm.nearest import nearest_in_time
from skarn.llm.sampling import proportional_sample, random_rank, seats_by_priority
from skarn.llm.splits import assign_components, deal_bins, grouped_splits, largest_differencing


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize(("hot", "one_task"), [(20_000, 0), (5, 0), (5, 250), (20_000, 500_000)])
def test_components(spark, monkeypatch, hot, one_task):
    monkeypatch.setattr("skarn.llm.components.HOT_EDGES", hot)
    monkeypatch.setattr("skarn.llm.components.ONE_TASK_EDGES", one_task)
    rnd = random.Random(7)
    e = [(f"n{rnd.randrange(300):03}", f"n{rnd.randrange(300):03}") for _ in range(170)]
    e += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"h{i:02}") for i in range(40)] + [("solo", "solo"), ("n001", "n001")]
    df = spark.createDataFrame(e + e[:20] + [(None, "n000"), ("x", None)], "a string, b string")
    assert {r[0]: r[1] for r in connected_components(df).collect()} == union_find(e)
    assert connected_components(df.limit(0)).count() == 0


def test_largest_differencing_balances():
    rnd = np.random.default_rng(2)
    rows = np.sort(rnd.uniform(1, 100, (50, 20)))[:, ::-1]
    of = largest_differencing(rows)
    assert all(sorted(r) == list(range(20)) for r in of)
    sums = np.bincount(of.ravel(), rows.ravel(), 20)
    naive = rows.sum(axis=0)
    assert np.ptp(sums) < 0.05 * np.ptp(naive)
    assert largest_differencing(np.zeros((0, 4))).shape == (0, 4)


def test_bins_follow_targets():
    of = deal_bins(np.full(200, 10.0), np.array([0.9, 0.05, 0.05]))
    assert Counter(of) == {0: 180, 1: 10, 2: 10}
    of = deal_bins(np.array([1000.0] + [1.0] * 10), np.array([0.5, 0.5, np.nan]))
    assert of[0] == 0 and set(of[1:]) == {1}


def records(spark, n=3000):
    rnd = random.Random(1)
    data = [(f"e{i}", rnd.choice([None, *[f"T{k}" for k in range(150)]]), rnd.choice([None, *[f"g{k}" for k in range(300)]]), "own") for i in range(n)]
    data += [(f"h{i}", "HOT", None, "own") for i in range(n // 3)] + data[:50] + [(None, "T1", "g1", "own"), ("e0", "T5", "g9", "own")]
    return spark.createDataFrame(data, "id string, t string, g string, component string"), data


def test_splits_keep_entities_together(spark):
    df, data = records(spark)
    targets = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2), (None, 0.5)], "split string, target_share double")
    out = grouped_splits(df, "id", [F.col("t"), F.col("g")], targets, bins=40, shard_components=30).collect()
    split = {r["id"]: r["split"] for r in out}
    assert len(out) == len({d[0] for d in data if d[0]}) and None not in split.values()
    seen = defaultdict(set)
    for i, t, g, _ in data:
        for k in (("t", t), ("g", g)):
            if i and k[1]:
                seen[k].add(split[i])
    assert all(len(s) == 1 for s in seen.values())
    component = {r["id"]: r["component"] for r in out}
    groups = union_find([(f"i{i}", f"{k}{v}") for i, t, g, _ in data if i for k, v in (("t", t), ("g", g)) if v])
    for (a, ca), (b, cb) in zip(list(component.items())[:400], list(component.items())[1:]):
        if f"i{a}" in groups and f"i{b}" in groups:
            assert (ca == cb) == (groups[f"i{a}"] == groups[f"i{b}"])


def test_split_shares(spark):
    w = spark.createDataFrame([(f"c{i}", 1 + i * i % 37) for i in range(2000)], "component string, weight long")
    t = spark.createDataFrame([("train", 0.9), ("validation", 0.05), ("test", 0.05)], "split string, target_share double")
    for options in ({}, {"bins": 100, "shard_components": 300}):
        got = {r[0]: r[1] for r in assign_components(w, t, **options).groupBy("split").sum("weight").collect()}
        total = sum(got.values())
        assert abs(got["train"] / total - 0.9) < 0.01 and abs(got["test"] / total - 0.05) < 0.01
    assert assign_components(w.limit(0), t).count() == 0
    assert assign_components(w, t.limit(0)).where("split is not null").count() == 0


def brute_seats(avail, share, floor, n):
    ranks = [((0 if r <= floor[i] else 1), (r - 0.5) / share[i] if share[i] else float("inf"), i) for i in range(len(avail)) for r in range(1, avail[i] + 1) if share[i] or r <= floor[i]]
    return [Counter(x[2] for x in sorted(ranks)[:n])[i] for i in range(len(avail))]


def test_seats_equal_the_smallest_priorities():
    rnd = random.Random(11)
    for _ in range(300):
        k = rnd.randrange(1, 7)
        avail, share, floor = [rnd.randrange(0, 60) for _ in range(k)], [rnd.choice([0.0, 0.1, 0.25, 0.3, 0.01]) for _ in range(k)], [rnd.randrange(0, 6) for _ in range(k)]
        n = rnd.randrange(0, 150)
        assert seats_by_priority(avail, share, floor, n) == brute_seats(avail, share, floor, n)


def test_random_rank_is_a_ranking(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string").substr(1, 1)).alias("c"), "id")
    for ranges in (1, 64, 4096):
        for r in random_rank(df, "c", F.xxhash64("id"), ranges).groupBy("c").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect():
            assert (r["d"], r["a"], r["b"]) == (r["n"], 1, r["n"])
    a = {r["id"]: r["rank"] for r in random_rank(df, "c", F.xxhash64("id"), 1).collect()}
    assert a == {r["id"]: r["rank"] for r in random_rank(df.repartition(5), "c", F.xxhash64("id"), 512).collect()}


def test_sample(spark):
    rnd = random.Random(3)
    data = [(f"e{i}", rnd.choices(["a", "b", "c", "other", None], [60, 20, 3, 10, 5])[0], rnd.choice(["HOT"] * 3 + [f"g{k}" for k in range(40)] + [None])) for i in range(2000)]
    df = spark.createDataFrame(data + data[:100], "id string, category string, g string")
    t = spark.createDataFrame([("a", 0.5, 5), ("b", 0.3, 5), ("c", 0.2, 5), ("d", 0.0, 7), (None, 0.1, 1)], "category string, target_share double, min_rows int")
    sample, report = proportional_sample(df, "id", F.col("category"), t, group=F.col("g"), max_per_group=4, n=200)
    avail = {c: sum(min(4, n) for (cc, g), n in Counter((c2, g2) for _, c2, g2 in data if g2).items() if cc == c) for c in "abcd"}
    got = {r["category"]: r for r in report.collect()}
    assert {c: r["available"] for c, r in got.items()} == avail
    assert {c for c, r in got.items() if r["short"]} == {c for c, (s, m) in {"a": (0.5, 5), "b": (0.3, 5), "c": (0.2, 5), "d": (0, 7)}.items() if avail[c] < max(m, s * 200)}
    picked = sample.collect()
    assert len(picked) == 200 == len({r["id"] for r in picked}) and max(Counter((r["category"], r["g"]) for r in picked).values()) <= 4
    assert Counter(r["category"] for r in picked) == {c: r["seats"] for c, r in got.items() if r["seats"]}
    own = t.withColumn("max_per_group", F.when(F.col("category") == "a", 2))
    few = {r["category"]: r["available"] for r in proportional_sample(df, "id", F.col("category"), own, group=F.col("g"), max_per_group=4, n=200)[1].collect()}
    assert few["a"] < avail["a"] and few["b"] == avail["b"]
    empty, none = proportional_sample(df.limit(0), "id", F.col("category"), t, n=10)
    assert empty.count() == 0 and {r["available"] for r in none.collect()} == {0}


@pytest.mark.parametrize("later", [True, False])
@pytest.mark.parametrize("tolerance", [0, 1, 5])
def test_nearest_against_brute_force(spark, monkeypatch, later, tolerance):
    monkeypatch.setattr("skarn.llm.nearest.SLICE_TOLERANCES", 3)
    rnd = random.Random(9)
    right = [(rnd.choice(["p", "p", "q", None]), rnd.choice([None, *range(-300, 300)])) for _ in range(160)]
    left = [(i, rnd.choice(["p", "q", "z", None]), rnd.choice([None, *range(-320, 320)]), 1) for i in range(500)]
    r = spark.createDataFrame(right + right[:9], "k string, t int")
    x = spark.createDataFrame(left + left[:5], "id int, k string, t int, lo int")
    got = nearest_in_time(x, r, left_key=F.col("k"), left_time=F.col("t"), right_key=F.col("k"), right_time=F.col("t"), tolerance=tolerance, later_wins=later)
    want = []
    for row in left + left[:5]:
        near = [t for k, t in right if k == row[1] and k and None not in (t, row[2]) and abs(t - row[2]) <= tolerance]
        if near:
            want.append((*row, min(near, key=lambda t: (abs(t - row[2]), -t if later else t))))
    assert got.columns == ["id", "k", "t", "lo", "nearest_time"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert nearest_in_time(x.limit(0), r, left_key=F.col("k"), left_time=F.col("t"), right_key=F.col("k"), right_time=F.col("t"), tolerance=1).count() == 0
