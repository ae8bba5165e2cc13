"""Small cases for cleaning, profiles, consensus, resolution, windows, splits, greedy picks, records and metrics."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from skarn.functions import clean as C
from skarn.functions import text as X
from skarn.functions.keys import folded, numeric_key, six_digits, ticker_root
from skarn.operators import consensus as K
from skarn.operators import evaluate as E
from skarn.operators import profile as P
from skarn.operators import records as R
from skarn.operators import resolve as J
from skarn.operators import returns as W
from skarn.operators import splitting as S
from skarn.operators.greedy import Cap, greedy_sample
from skarn.sources.html import page_text
from skarn.streaming.counts import tumbling_counts


def one(spark, schema, row, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*cols).first())


def test_keys(spark):
    f = lambda x: one(spark, "c string", (x,), ticker_root(F.col("c")), numeric_key(F.col("c")), folded(F.col("c")))
    assert f(" abc.OQ ") == ("ABC", "abc.OQ", "abc.oq")
    assert f("a.bcd")[0] == "A.BCD" and f(".n")[0] is None and f("a.b.c")[0] == "A.B"
    assert f(" 00670 ")[1] == "670" and f("000")[1] == "0" and f("  ") == (None, None, None) and f(None) == (None, None, None)
    assert one(spark, "c string", ("12",), six_digits(F.col("c"))) == ("000012",)


def test_clean(spark):
    c = F.col("c")
    assert one(spark, "c string", ("  ",), C.blank_to_null(c), C.safe_number(c), C.safe_date(c)) == (None, None, None)
    assert one(spark, "c string", ("C",), C.safe_number(c), C.safe_number(c, "int"), C.safe_date(c)) == (None, None, None)
    assert one(spark, "c string", ("2020-02-29",), C.safe_date(c)) == (date(2020, 2, 29),)
    d, p = F.col("d"), F.col("p")
    label = lambda a, b: one(spark, "d double, p double", (a, b), C.direction_label(d), C.magnitude_bucket(d, p))
    assert label(None, None) == ("neutral", "unknown") and label(0.0049, 0.9) == ("neutral", "flat") and label(0.005, 0.05) == ("positive", "medium")
    assert label(-1.0, 0.15) == ("negative", "large") and label(0.2, None) == ("positive", "medium") and label(0.25, None)[1] == "large" and label(0.01, -0.049)[1] == "small"
    assert one(spark, "d double, p double", (1.0, 0.0), C.pct_change(d, p)) == (None,)
    assert one(spark, "d double, p double", (1.0, -2.0), C.pct_change(d, p)) == (0.5,)


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), (" ", None), (None, 3), ("a", 4)], "t string, n int")
    assert {r["column_name"]: r["null_rate"] for r in P.null_rates(df).collect()} == {"t": 0.5, "n": 0.25}
    assert {r["null_rate"] for r in P.null_rates(df.limit(0)).collect()} == {0.0}
    assert P.entropy_bits(df, ["n"]).first()["entropy"] == 2.0
    assert tuple(P.duplicate_rate(df, [], F.col("t")).first()) == (4, 1, 0.25)
    # index round_half_even(3 x 0.5) = 2 of 1, 2, 3, 4
    v = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int").withColumn("g", F.lit(1))
    assert tuple(P.nearest_rank(v, ["g"], "v", [0.5, 0.95]).first()) == (1, 4, 3, 4)


def test_consensus_first_event_and_median(spark):
    rows = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), ("a", 1, 9.0), ("a", 2, 2.004), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double").withColumns({"an": F.lit(1), "es": F.lit(None).cast("int")})
    g = K.with_change_labels(K.consensus(df, ["k", "d"], "v", "an", "es", []), ["k"], [F.col("d")])
    got = {(r["k"], r["d"]): (r["consensus_median"], r["direction_label"], r["magnitude_bucket"], r["estimator_count"]) for r in g.collect()}
    assert got == {("a", 1): (2.0, "neutral", "unknown", 0), ("a", 2): (2.004, "neutral", "flat", 0), ("b", 1): (5.0, "neutral", "unknown", 0)}


def test_layout_does_not_change_survivors(spark):
    df = spark.createDataFrame([(i % 7, i % 3, i) for i in range(100)], "k int, a int, b int")
    f = lambda n: sorted(map(tuple, K.latest_per_key(df.repartition(n), ["k"], [F.desc("a"), F.col("b")]).collect()))
    assert f(1) == f(5) and len(f(2)) == 7


def test_range_join_edges(spark):
    d = lambda n: date(2024, 1, n)
    a = spark.createDataFrame([("x", d(1)), (None, d(1)), ("", d(1))], "k string, ed date")
    b = spark.createDataFrame([("x", d(1)), ("x", d(8)), ("x", d(9)), (None, d(1)), ("", d(1))], "k string, td date")
    assert sorted(r["td"] for r in J.forward_range_join(a, b, ["k"], "ed", "td", 7).collect()) == [d(1), d(8)]


def test_resolution_prefers_confidence_then_day_then_security(spark):
    d = lambda n: date(2024, 1, n)
    ev = spark.createDataFrame([("e1", d(1), "c1", "t1"), ("e2", d(1), None, "t1"), ("e3", d(1), "zz", "  ")], "event_id string, ed date, cusip string, tick string")
    day = spark.createDataFrame([(7, d(3), "c1", "t0"), (5, d(2), "c9", "t1"), (4, d(2), "c8", "t1"), (1, d(9), "c1", "t1")], "permno int, td date, cusip string, tick string")
    keys = J.event_keys(ev, "event_id", "ed", {"cusip": (F.col("cusip"), 0.95), "ticker": (F.col("tick"), 0.75)})
    sec = J.security_keys(day, "permno", "td", {"cusip": F.col("cusip"), "ticker": F.col("tick")})
    p = J.with_resolution(ev, "event_id", J.resolve_first(keys, sec))
    assert {r["event_id"]: (r["security"], r["join_method"], r["join_status"]) for r in p.collect()} == {"e1": (7, "cusip", "matched"), "e2": (4, "ticker", "matched"), "e3": (None, "none", "unmatched")}
    assert [r["event_id"] for r in J.unmatched(ev, p.where("join_status = 'matched'"), "event_id").collect()] == ["e3"]


def test_windows(spark):
    assert W.window_slug("-1:5") == "w_m1_p5"
    for bad in ("1", "2:1", "a:b"):
        with pytest.raises(ValueError):
            W.parse_window(bad)
    df = spark.createDataFrame([(1, 1, 0.1, 0.0), (1, 2, -1.0, None), (1, 3, 0.2, 0.1)], "p int, trade_idx int, ret double, bench double")
    got = {r["trade_idx"]: r for r in W.window_returns(df, "p", ["0:1", "-1:-1"], benchmark="bench").collect()}
    assert got[1]["raw_return_w_p0_p1"] == pytest.approx(0.1) and got[1]["obs_count_w_p0_p1"] == 2  # the total loss counts as seen, not as a return
    assert got[2]["raw_return_w_p0_p1"] == pytest.approx(0.2) and got[1]["raw_return_w_m1_m1"] is None and got[1]["abnormal_return_w_m1_m1"] is None
    assert got[2]["benchmark_return_w_p0_p1"] == pytest.approx(0.1) and got[3]["raw_return_w_m1_m1"] is None


def test_chronological_split_reproduces_the_percent_rank_rule(spark):
    df = spark.range(2000).select(F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") / 13).cast("int")).alias("day"), "id")
    got = {r[0]: r[1] for r in S.chronological_split(df.repartition(7), "day", ["id"]).groupBy("split").count().collect()}
    n = 2000
    want = [sum(1 for i in range(n) if i / (n - 1) < 0.9), sum(1 for i in range(n) if 0.9 <= i / (n - 1) < 0.9 + 0.05)]
    assert got == {"train": want[0], "val": want[1], "test": n - sum(want)}
    assert S.chronological_split(df.limit(1), "day", ["id"]).first()["split"] == "train"
    assert S.chronological_split(df.limit(0), "day", ["id"]).count() == 0


def test_greedy_equals_a_plain_pass_in_small_chunks(spark):
    data = [(f"r{i}", f"t{i * i % 7}", "np"[i % 2], (i * 37) % 101, f"s{i // 2}") for i in range(200)]
    df = spark.createDataFrame(data, "id string, t string, d string, o int, s string").drop("id").withColumn("rid", F.concat(F.lit("r"), F.monotonically_increasing_id()))
    data = [(r["rid"], r["t"], r["d"], r["o"], r["s"]) for r in df.collect()]
    caps = [Cap("t", F.col("t"), 9), Cap("d", F.col("d"), {"n": 14, "p": 30})]
    from collections import Counter

    taken, n, used = [], Counter(), set()
    for r in sorted(data, key=lambda r: (r[3], r[0])):
        if len(taken) < 40 and n[r[1]] < 9 and n[r[2]] < {"n": 14, "p": 30}[r[2]] and r[4] not in used:
            taken.append(r[0])
            n.update([r[1], r[2]])
            used.add(r[4])
    fixed = spark.createDataFrame(data, "rid string, t string, d string, o int, s string")
    for chunk in (7, 50_000):
        got = greedy_sample(fixed, "rid", [F.col("o")], caps, 40, unique=F.col("s"), chunk=chunk).orderBy("pick_order").collect()
        assert [r["rid"] for r in got] == taken
    full = greedy_sample(fixed, "rid", [F.col("o")], caps, 90, [F.col("o")], unique=F.col("s"))
    assert full.count() == 90
    assert greedy_sample(fixed.limit(0), "rid", [F.col("o")], caps, 5).count() == 0


def test_think_label_and_json(spark):
    c = F.col("c")

    def f(t):
        p = X.think_parts(c)
        return one(spark, "c string", (t,), p["think_text"], p["malformed"], p["stripped"], p["json_after_text"], X.label_in_text(p["stripped"]), X.json_blob(p["stripped"]))

    assert f('<think>a\nb</think> {"x": 1} ') == ("a\nb", False, '{"x": 1}', False, None, '{"x": 1}')
    assert f("<think>open positive")[:3] == (None, True, "<think>open positive")
    assert f("<think>1</think>x<think>2</think>y no") == ("1", True, "x<think>2</think>y no", False, "no", None)
    assert f('so: {"a": {"b": 2}} done')[3:] == (True, None, '{"a": {"b": 2}}')
    assert f("[1, 2]")[5] is None and f("not positive, negative")[4] == "positive" and f("eyes nothing")[4] is None and f("}{")[5] is None
    assert f("") == (None, False, "", False, None, None) and f(None)[2] is None


def test_signatures_ignore_case_and_space(spark):
    s = X.signature(F.col("a"), F.col("b"))
    f = lambda *r: one(spark, "a string, b string", r, s)
    assert f(" A  b", "c") == f("a b", "C ") != f("a", "b c") and f(None, "x") != f("x", None)


def test_html():
    page = "<html><script>var a;</script><p>Intro</p>\n<b>FORM 10-K</b> x &amp; y<p>FORM 8-K late</p></html>"
    assert page_text(page) == "FORM 8-K late" and page_text("<i>plain</i> text") == "plain text" and page_text("") == ""


def test_record_errors(spark):
    turn = lambda r, c: (r, c)
    data = [(1, "i", "{\"a\":1}", [turn("user", "u"), turn("assistant", "{\"a\":1}")]), (2, " ", "x", [turn("assistant", "{\"a\":1}")]), (3, "i", "bad", [turn("assistant", "bad")]), (4, "i", "o", []), (5, "i", "o", None), (6, "i", "{}", [turn("assistant", "{}")])]
    df = spark.createDataFrame(data, "id int, i string, o string, m array<struct<role: string, content: string>>")
    got = sorted(map(tuple, R.record_errors(df, "id", F.col("i"), F.col("o"), F.col("m"), ["a"]).collect()))
    assert got == [(2, "empty input"), (2, "output mismatch"), (3, "invalid json"), (4, "missing assistant message"), (5, "missing assistant message"), (6, "missing keys: a")]
    with pytest.raises(ValueError):
        R.require_valid(R.record_errors(df, "id", F.col("i"), F.col("o"), F.col("m"), ["a"]))
    talk = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "c int, t int, r string, x string")
    assert [m["content"] for m in R.conversation_messages(talk, "c", "t", "r", "x").first()["messages"]] == ["a", "b"]


def test_metrics_with_unknown_and_missing_predictions(spark):
    # recorded counts: 81 + 2 neutral golds of which two were answered 'no'
    cells = {("neutral", "neutral"): 60, ("neutral", "positive"): 21, ("neutral", "no"): 2, ("positive", "positive"): 30, ("positive", None): 1, ("odd", "positive"): 4}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "gold string, pred string")
    labels = ["negative", "neutral", "positive"]
    m = {r["label"]: r for r in E.class_metrics(df, [], labels).collect()}
    assert m["neutral"]["support"] == 81 and m["neutral"]["recall"] == pytest.approx(60 / 81) and m["negative"]["f1"] == 0
    assert m["positive"]["precision"] == pytest.approx(30 / 51) and m["positive"]["support"] == 31
    s = E.summary_metrics(df, [], labels).first()
    assert s["accuracy"] == pytest.approx(90 / 118) and s["invalid_count"] == 1
    assert s["macro_f1"] == pytest.approx(sum(r["f1"] for r in m.values()) / 3)
    assert E.structured_match(df, [], {"x": (F.col("gold"), F.col("pred")), "y": (F.lit(None), F.lit(None))}).first()["y_accuracy"] == 1.0


def test_verdicts(spark):
    rows = [("d1", "base", 0.5, 0.5, 0.1), ("d1", "tuned", 0.6, 0.6, 0.1), ("d2", "base", 0.5, 0.5, 0.1), ("d2", "tuned", 0.6, 0.5, 0.2), ("d3", "base", 0.5, 0.5, 0.1), ("d3", "tuned", 0.5, 0.5, 0.0)]
    m = spark.createDataFrame(rows, "dataset string, variant string, accuracy double, macro_f1 double, parse_failure_rate double")
    got = {r["dataset"]: r["verdict"] for r in E.metric_deltas(m, ["dataset"], "variant", "base", "tuned", ["accuracy", "macro_f1", "parse_failure_rate"]).collect()}
    assert got == {"d1": "improved", "d2": "regressed", "d3": "inconclusive"}


def test_stream_counts_equal_batch(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/events.parquet")
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    q = tumbling_counts(spark.readStream.schema(df.schema).parquet(src), "ts", "event_type", "value", "1 day", "60 days").writeStream.outputMode("update").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    stream = {(r[0], r[1]): r[2] for r in spark.sql("select window_start, event_type, max(n) from tumbling group by 1, 2").collect()}
    batch = {(r["window_start"], r["event_type"]): r["n"] for r in tumbling_counts(df, "ts", "event_type", "value", "1 day").collect()}
    assert stream == batch and math.fsum(batch.values()) == df.count()


def test_global_rank_with_a_hot_day_and_ties(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, date(2024, 1, 5)).otherwise(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 9).cast("int"))).alias("day"), (F.col("id") % 100).alias("x"))
    from collections import Counter

    keys = sorted((r["day"], r["x"]) for r in df.collect())
    first = {}
    for i, k in enumerate(keys, 1):
        first.setdefault(k, i)
    got = S.global_rank(df.repartition(6), ["day", "x"]).collect()
    assert len(got) == 3000 and {r["n"] for r in got} == {3000}
    assert Counter((r["day"], r["x"], r["rank"]) for r in got) == Counter((*k, first[k]) for k in keys)
    assert S.global_rank(df.limit(0), ["day"]).count() == 0


def test_nearest_rank_against_sorting(spark, monkeypatch):
    import random

    monkeypatch.setattr(P, "SKETCH_ACCURACY", 50)
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)])) for _ in range(700)] + [("one", 5), ("none", None)]
    got = {r["g"]: tuple(r)[1:] for r in P.nearest_rank(spark.createDataFrame(data, "g string, v int"), ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        v = sorted(x for k, x in data if k == g and x is not None)
        want[g] = (len(v), *[v[min(len(v) - 1, round((len(v) - 1) * p))] for p in (0.0, 0.5, 0.95, 1.0)])
    assert got == want


def test_interval_join_against_brute_force(spark, monkeypatch):
    import random
    from datetime import date, timedelta

    monkeypatch.setattr(J, "INTERVAL_DAYS", 7)
    rnd = random.Random(6)
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    left = [(i, rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, *[day(rnd.randrange(120)) for _ in range(9)]])) for i in range(200)]
    right = [(i, rnd.choice(["hot", "b", None]), rnd.choice([None, *[day(rnd.randrange(-50, 150)) for _ in range(9)]]), rnd.choice([None, day(rnd.randrange(-50, 170)), date(9999, 12, 31)])) for i in range(60)]
    a, b = spark.createDataFrame(left, "l int, k string, day date"), spark.createDataFrame(right, "r int, k string, f date, t date")
    got = sorted((x["l"], x["r"]) for x in J.interval_join(a, b, ["k"], "day", "f", "t").collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and x[2] and y[2] and y[2] <= x[2] and (y[3] is None or x[2] <= y[3])) and got
    assert J.interval_join(a.limit(0), b, ["k"], "day", "f", "t").count() == 0 == J.interval_join(a, b.limit(0), ["k"], "day", "f", "t").count()


def test_chronological_split_with_nulls_and_ties(spark):
    rows = [(i, None if i % 10 == 0 else f"2020-01-{i % 7 + 1:02}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, d string").withColumn("day", F.to_date("d"))
    got = {r["id"]: r["split"] for r in S.chronological_split(df, "day", ["id"], 0.6, 0.2).collect()}
    order = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    assert got == {r[0]: "train" if i / 99 < 0.6 else "val" if i / 99 < 0.6 + 0.2 else "test" for i, r in enumerate(order)}
    assert [r["split"] for r in S.chronological_split(df.limit(1), "day", ["id"]).collect()] == ["train"] and S.chronological_split(df.limit(0), "day", ["id"]).count() == 0


def test_held_out_and_mix(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("k"), F.when(F.col("id") % 3 == 0, "positive").otherwise("negative").alias("label"), F.lit("s").alias("src"))
    x = S.held_out(df, "k", 0.2, 1)
    assert x.groupBy("k").agg(F.count_distinct("held_out").alias("n")).where("n > 1").count() == 0
    assert abs(x.where("held_out").count() / 4000 - 0.2) < 0.04
    m = S.source_mix(df.withColumn("id", F.monotonically_increasing_id()), "src", "label", "id", F.col("k").cast("string"), {"positive": 5, "negative": 3, "neutral": 9}).groupBy("label").count().collect()
    assert {r[0]: r[1] for r in m} == {"positive": 5, "negative": 3}
