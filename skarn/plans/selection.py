"""Splits, samples, greedy selections and set comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.keys import folded
from skarn.functions.text import signature
from skarn.operators import splitting as S
from skarn.operators.greedy import Cap, greedy_sample
from skarn.operators.resolve import union_all
from skarn.plans.estimates import gold
from skarn.session import cut
from skarn.sources.tables import table as T

#: Rows of the samples: balanced, diverse, best supported.
BALANCED, DIVERSE, QUALITY = 10_000, 10_000, 4_000
#: Rows of capped splits.
CAPS = {"train": 500, "val": 60, "test": 40}


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def chrono_split(spark, d):
    return S.chronological_split(_orders(spark, d), "day", ["o_orderkey"]).select("o_orderkey", "split")


def split_counts(spark, d):
    x = S.chronological_split(_orders(spark, d), "day", ["o_orderkey"])
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"))


def split_label_dist(spark, d):
    x = S.chronological_split(_orders(spark, d), "day", ["o_orderkey"])
    return x.groupBy("split", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def hash_sample_topn(spark, d):
    return S.hash_sample(T(spark, d, "orders"), "o_orderkey", 1000, 42).select("o_orderkey", "o_custkey")


def sequential_splits(spark, d):
    return S.sequential_splits(T(spark, d, "orders"), "o_orderkey", [("train", 800), ("eval", 100), ("holdout", 100)], 42).select("o_orderkey", "split")


def stratified_quota(spark, d):
    x = T(spark, d, "documents").select("doc_id", F.coalesce(folded(F.col("source")), F.lit("unknown")).alias("source"), F.coalesce(folded(F.col("lang")), F.lit("unknown")).alias("lang"))
    return S.quota_per_group(x, ["source", "lang"], 20, "doc_id", 40)


def grouped_topk(spark, d):
    x = S.top_per_group(T(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)
    return x.select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


def split_diff(spark, d):
    y = lambda n: T(spark, d, "orders").where(F.year("o_orderdate") == n)
    return S.set_difference(y(1996), y(1995), "o_custkey")


def signature_reuse(spark, d):
    y = lambda n: T(spark, d, "orders").where(F.year("o_orderdate") == n).withColumn("sig", signature(F.col("o_custkey"), F.col("o_orderpriority")))
    return S.reuse_rate(y(1995), y(1996), "sig")


def split_overlap(spark, d):
    return S.split_overlap(T(spark, d, "ibes_pipeline"), "split", "event_id")


def held_out_events(spark, d):
    x = S.held_out(T(spark, d, "events"), "user_id", 0.226, 42)
    return x.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def source_mix(spark, d):
    x = T(spark, d, "ibes_pipeline").select("record_id", F.coalesce(folded(F.col("source")), F.lit("unknown")).alias("source"), folded(F.col("direction_label")).alias("label"), "structured_input")
    return S.source_mix(x, "source", "label", "record_id", F.md5("structured_input"), {"negative": 30, "neutral": 30, "positive": 40}, 44).select("record_id", "source", "label")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    # read by every pass of a sampler
    return cut(gold(spark, d).select(
        F.concat_ws("|", "company", "period").alias("event_id"), F.col("company").cast("string").alias("ticker"), F.year("period").cast("string").alias("year"), F.col("period").cast("string").alias("period"),
        "direction_label", "magnitude_bucket", "estimate_count", "analyst_count", "consensus_std", "prior_consensus_median", signature(F.col("company"), F.col("consensus_median")).alias("sig"),
    ))


def _thirds(total: int) -> dict[str, int]:
    return {"negative": total // 3, "neutral": total // 3, "positive": total - 2 * (total // 3)}


def greedy_balanced(spark, d):
    """Direction quotas of a third, equal quotas per magnitude, caps per ticker and period, then backfill."""
    x, total = _candidates(spark, d), BALANCED
    seen = {r[0]: r[1] for r in x.groupBy("direction_label").agg(F.count_distinct("magnitude_bucket")).collect()}
    per = {f"{k}|{m}": max(1, math.ceil(q / max(1, seen.get(k, 1)))) for k, q in _thirds(total).items() for m in ("unknown", "flat", "small", "medium", "large")}
    h = S.hash_order(F.col("event_id"), seed=42)
    caps = [
        Cap("direction", F.col("direction_label"), _thirds(total)), Cap("magnitude", F.concat_ws("|", "direction_label", "magnitude_bucket"), per),
        Cap("ticker", F.col("ticker"), max(8, total // 800)), Cap("period", F.col("period"), max(6, total // 1200)),
    ]
    return greedy_sample(x, "event_id", [F.col("direction_label"), S.hash_order(F.col("magnitude_bucket"), seed=42), h], caps, total, [S.hash_order(F.col("event_id"), seed=141)], F.col("sig"))


def greedy_diverse(spark, d):
    """Caps per ticker and period, in hash order, then backfill in the same order."""
    caps = [Cap("ticker", F.col("ticker"), max(4, DIVERSE // 1600)), Cap("period", F.col("period"), max(4, DIVERSE // 1800))]
    h = [S.hash_order(F.col("event_id"), seed=42)]
    return greedy_sample(_candidates(spark, d), "event_id", h, caps, DIVERSE, h, F.col("sig"))


def greedy_quality(spark, d):
    """Best supported events first: three points an analyst, two an estimate, less the deviation (its median if null)."""
    x = _candidates(spark, d).where("prior_consensus_median is not null and estimate_count >= 2 and analyst_count >= 2")
    mid = x.agg(F.percentile_approx("consensus_std", 0.5)).scalar()
    x = x.withColumn("score", F.round(F.coalesce(F.col("analyst_count") * 3 + F.col("estimate_count") * 2 - F.coalesce("consensus_std", mid), F.lit(0.0)), 6))
    caps = [Cap("direction", F.col("direction_label"), _thirds(QUALITY)), Cap("ticker", F.col("ticker"), max(3, QUALITY // 1200))]
    best = [-F.col("score"), F.col("period")]
    return greedy_sample(x, "event_id", best, caps, QUALITY, best, F.col("sig"))


def greedy_capped(spark, d):
    """The best supported events with at most four of a ticker, and no backfill."""
    x = _candidates(spark, d).where("prior_consensus_median is not null and estimate_count >= 2 and analyst_count >= 2")
    x = x.withColumn("score", F.col("analyst_count") * 3 + F.col("estimate_count") * 2)
    return greedy_sample(x, "event_id", [-F.col("score"), F.col("period")], [Cap("direction", F.col("direction_label"), _thirds(QUALITY)), Cap("ticker", F.col("ticker"), 4)], QUALITY, None, F.col("sig"))


def diverse_head(spark, d):
    """The head of the diverse sample that goes into a mix of four to one."""
    return greedy_diverse(spark, d).where(F.col("pick_order") <= DIVERSE * 4 // 5)


def capped_splits(spark, d):
    """Chronological splits, each cut to a number of rows by hash."""
    x = S.chronological_split(_orders(spark, d), "day", ["o_orderkey"])
    return union_all([S.hash_sample(x.where(F.col("split") == s), "o_orderkey", n, 42 + i) for i, (s, n) in enumerate(CAPS.items())]).select("o_orderkey", "split")


QUERIES = {f.__name__: f for f in (
    chrono_split, split_counts, split_label_dist, hash_sample_topn, sequential_splits, stratified_quota, grouped_topk, split_diff, signature_reuse, split_overlap, held_out_events, source_mix, greedy_balanced, greedy_diverse, greedy_quality, greedy_capped, diverse_head, capped_splits,
)}

_PR = """r as (select *, percent_rank() over (order by cast(o_orderdate as date), o_orderkey) as pr from orders),
sp as (select *, case when pr < 0.9 then 'train' when pr < 0.9 + 0.05 then 'val' else 'test' end as split from r)"""
_H = lambda key, seed: f"md5(cast({key} as varchar) || '#{seed}')"

SQL = {
    "chrono_split": f"with {_PR} select o_orderkey, split from sp",
    "split_counts": f"with {_PR} select split, count(*) as n, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from sp group by split",
    "split_label_dist": f"with {_PR} select split, o_orderpriority, count(*) as n from sp group by all",
    "hash_sample_topn": f"select o_orderkey, o_custkey from orders order by {_H('o_orderkey', 42)}, o_orderkey limit 1000",
    "sequential_splits": f"""with r as (select o_orderkey, row_number() over (order by {_H('o_orderkey', 42)}, o_orderkey) as rn from orders)
select o_orderkey, case when rn <= 800 then 'train' when rn <= 900 then 'eval' else 'holdout' end as split from r where rn <= 1000""",
    "stratified_quota": f"""with x as (select doc_id, coalesce(nullif(lower(trim(source)), ''), 'unknown') as source, coalesce(nullif(lower(trim(lang)), ''), 'unknown') as lang from documents),
r as (select *, row_number() over (partition by source, lang order by {_H('doc_id', 40)}, doc_id) as rn from x) select doc_id, source, lang from r where rn <= 20""",
    "grouped_topk": "select * from (select o_orderpriority, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as integer) as rank, o_orderkey, o_totalprice from orders) where rank <= 10",
    "capped_splits": f"with {_PR} " + " union all ".join(f"select * from (select o_orderkey, split from sp where split = '{s}' order by {_H('o_orderkey', 42 + i)}, o_orderkey limit {n})" for i, (s, n) in enumerate(CAPS.items())),
    "split_diff": "select distinct o_custkey from orders where year(o_orderdate) = 1996 except select o_custkey from orders where year(o_orderdate) = 1995",
    "signature_reuse": """with a as (select distinct o_custkey, o_orderpriority from orders where year(o_orderdate) = 1995), b as (select distinct o_custkey, o_orderpriority from orders where year(o_orderdate) = 1996),
j as (select b.*, a.o_custkey is not null as hit from b left join a using (o_custkey, o_orderpriority))
select count(*) filter (not hit) as added, count(*) as total, count(*) filter (hit) as shared, round(1 - count(*) filter (not hit) / count(*), 4) as reuse_rate from j""",
    "held_out_events": "select held_out, count(*) as n, count(distinct user_id) as users from (select *, cast('0x' || substr(md5(cast(user_id as varchar) || '#42'), 1, 8) as bigint) / 4294967296.0 < 0.226 as held_out from events) group by held_out",
    "source_mix": """with x as (select record_id, coalesce(nullif(lower(trim(source)), ''), 'unknown') as source, nullif(lower(trim(direction_label)), '') as label, structured_input, md5(cast(record_id as varchar) || '#44') as h from ibes_pipeline),
o as (select *, row_number() over (partition by source, structured_input order by h, record_id) as a from x where label in ('negative', 'neutral', 'positive')),
k as (select *, row_number() over (partition by source, label order by h, record_id) as rn from o where a = 1) select record_id, source, label from k where rn <= case label when 'positive' then 40 else 30 end""",
    "split_overlap": "select event_id, count(distinct split) as splits, string_agg(distinct split, ',' order by split) as split_list from ibes_pipeline where event_id is not null group by event_id having count(distinct split) > 1",
}


def _greedy_sql(rows: str, order: str, then: str | None, keys: list[str], most: list[str], total: int) -> str:
    """The sequential pass as a fold over the ordered rows: ids taken, signatures taken and a count per key; then the backfill."""
    free = " and ".join(f"coalesce(acc.c[x.k[{i}]], 0) < x.m[{i}]" for i in range(1, len(keys) + 1))
    up = ", ".join(f"coalesce(acc.c[x.k[{i}]], 0) + 1" for i in range(1, len(keys) + 1))
    ks = ", ".join(f"'{i}|' || {k}" for i, k in enumerate(keys))
    last = "a" if then is None else "b"
    then = then or order
    return f"""with {{gold}}, cand as materialized (select *, row_number() over (order by event_id)::int as i, dense_rank() over (order by company, consensus_median)::int as sig from ({rows})),
one as (select list({{{{'i': i, 's': sig, 'k': [{ks}], 'm': [{', '.join(most)}]}}}} order by {order}, event_id) as xs, list({{{{'i': i, 's': sig}}}} order by {then}, event_id) as ys from cand),
a as (select ys, list_reduce(xs, lambda acc, x: case when len(acc.t) < {total} and not list_contains(acc.s, x.s) and {free} then {{{{'t': list_append(acc.t, x.i), 's': list_append(acc.s, x.s), 'c': map_concat(acc.c, map(x.k, [{up}]))}}}} else acc end,
  {{{{'t': []::int[], 's': []::int[], 'c': map([]::varchar[], []::int[])}}}}) as z from one),
b as (select list_reduce(ys, lambda acc, y: case when len(acc.t) < {total} and not list_contains(acc.s, y.s) and not list_contains(acc.t, y.i) then {{{{'t': list_append(acc.t, y.i), 's': list_append(acc.s, y.s)}}}} else acc end, {{{{'t': z.t, 's': z.s}}}}) as z from a),
u as (select unnest(z.t) as i, unnest(range(1, len(z.t) + 1))::int as pick_order from {last})
select event_id, pick_order from u join cand using (i)"""


def _greedy() -> dict[str, str]:
    from skarn.plans.estimates import GOLD_SQL

    rows = "select *, company || '|' || strftime(period, '%Y-%m-%d') as event_id, cast(company as varchar) as ticker, strftime(period, '%Y-%m-%d') as per, direction_label || '|' || magnitude_bucket as dm from labelled"
    third = lambda n: f"case direction_label when 'positive' then {_thirds(n)['positive']} else {_thirds(n)['negative']} end"
    seen = "(select count(distinct magnitude_bucket) from labelled l where l.direction_label = cand.direction_label)"
    h = lambda c, n: f"md5({c} || '#{n}')"
    good = f"""select *, round(coalesce(analyst_count * 3 + estimate_count * 2 - coalesce(consensus_std, (select quantile_disc(consensus_std, 0.5) from labelled where prior_consensus_median is not null and estimate_count >= 2 and analyst_count >= 2)), 0), 6) as score
  from ({rows}) where prior_consensus_median is not null and estimate_count >= 2 and analyst_count >= 2"""
    out = {
        "greedy_balanced": _greedy_sql(rows, f"direction_label, {h('magnitude_bucket', 42)}, {h('event_id', 42)}", h("event_id", 141), ["direction_label", "dm", "ticker", "per"],
            [third(BALANCED), f"greatest(1, ceil(({third(BALANCED)})::double / {seen}))::int", str(max(8, BALANCED // 800)), str(max(6, BALANCED // 1200))], BALANCED),
        "greedy_diverse": _greedy_sql(rows, h("event_id", 42), h("event_id", 42), ["ticker", "per"], [str(max(4, DIVERSE // 1600)), str(max(4, DIVERSE // 1800))], DIVERSE),
        "greedy_quality": _greedy_sql(good, "-score, per", "-score, per", ["direction_label", "ticker"], [third(QUALITY), str(max(3, QUALITY // 1200))], QUALITY),
        "greedy_capped": _greedy_sql(f"select *, analyst_count * 3 + estimate_count * 2 as score from ({rows}) where prior_consensus_median is not null and estimate_count >= 2 and analyst_count >= 2", "-score, per", None, ["direction_label", "ticker"], [third(QUALITY), "4"], QUALITY),
    }
    sql = {k: v.format(gold=GOLD_SQL) for k, v in out.items()}
    return sql | {"diverse_head": f"select * from ({sql['greedy_diverse']}) where pick_order <= {DIVERSE * 4 // 5}"}


SQL |= _greedy()
