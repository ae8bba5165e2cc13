import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from skarn.operators.bitemporal import as_known
from skarn.plans.links import events_with_permno

D0 = date(2020, 1, 1)
EV = "id int, k string, v date, r date, known_by string"
VE = "k string, vf date, vt date, rf date, rt date, x int, id int"


def known(spark, events, versions, width=16):
    c = F.col
    e = spark.createDataFrame(events, EV)
    v = spark.createDataFrame(versions, VE)
    return as_known(e, v, event_key=c("k"), event_day=c("v"), known_day=c("r"), version_key=c("k"), valid_from=c("vf"), valid_to=c("vt"), recorded_from=c("rf"), recorded_to=c("rt"), rank=[F.unix_date("rf"), c("x")], payload=["x"], width=width)


def brute(event, versions):
    _, k, v, r, _ = event
    if None in (k, v, r):
        return None
    fits = [(w[3], w[5]) for w in versions if w[0] == k and None not in (w[1], w[3], w[5]) and w[1] <= v and (w[2] is None or v <= w[2]) and w[3] <= r and (w[4] is None or r <= w[4])]
    return max(fits)[1] if fits else None


def test_against_brute_force(spark):
    rnd = random.Random(5)
    day = lambda n=60: D0 + timedelta(days=rnd.randrange(n))
    maybe = lambda x: x if rnd.random() < 0.85 else None
    versions = []
    for _ in range(120):
        a, r = day(), day()
        versions.append((maybe(rnd.choice("abc")), maybe(a), maybe(a + timedelta(days=rnd.randrange(-5, 30))), maybe(r), maybe(r + timedelta(days=rnd.randrange(0, 40))), rnd.randrange(9), 0))
    versions += versions[:20]
    events = [(i, maybe(rnd.choice("abcd")), maybe(day(80)), maybe(day(80)), None) for i in range(400)]
    got = {x["id"]: x["known"]["x"] if x["known"] else None for x in known(spark, events, versions).collect()}
    # a null end is open, a reversed interval holds nothing
    want = {e[0]: brute(e, versions) for e in events}
    assert got == want


def test_later_record_is_not_seen_earlier(spark):
    v = [("a", D0, None, D0, None, 1, 0), ("a", D0, None, D0 + timedelta(days=10), None, 2, 0)]
    at = lambda n: D0 + timedelta(days=n)
    got = known(spark, [(1, "a", at(5), at(9), None), (2, "a", at(5), at(10), None), (3, "a", at(-1), at(30), None)], v)
    assert {x["id"]: x["known"] and x["known"]["x"] for x in got.collect()} == {1: 1, 2: 2, 3: None}


def test_empty_and_clashing_names(spark):
    e, v = [(1, "a", D0, D0, "own")], [("a", D0, None, D0, None, 7, 99)]
    out = known(spark, e, v)
    assert out.columns == ["id", "k", "v", "r", "known_by", "known"]
    assert out.first()["id"] == 1 and out.first()["known_by"] == "own"
    assert known(spark, [], v).count() == 0
    assert known(spark, e, []).first()["known"] is None


def test_hot_key_keeps_all_events(spark):
    e = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit(" 0007").alias("gvkey"), F.date_add(F.lit(D0), (F.col("id") % 700).cast("int")).alias("event_date"))
    links = spark.createDataFrame([("000007", 5, D0, D0 + timedelta(days=299)), ("000007", 3, D0 + timedelta(days=100), D0 + timedelta(days=699)), ("000007", 4, D0 + timedelta(days=100), D0 + timedelta(days=699))], "gvkey string, permno int, linkdt date, linkenddt date")
    got = events_with_permno(e.unionByName(e), links).groupBy("permno").count().collect()
    assert {r[0]: r[1] for r in got} == {5: 500, 3: 2500}
