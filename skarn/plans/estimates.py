"""Cleaning, profiling, deduplication and consensus queries. Line items stand in for estimates: company = supplier,
period = month of shipment, analyst = part, estimator = line number, value = extended price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import clean as C
from skarn.operators import consensus as K
from skarn.operators import profile as P
from skarn.operators.resolve import union_all
from skarn.sources.tables import table as T

ALL_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def estimates(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("period"), F.col("l_partkey").alias("analyst"),
        F.col("l_linenumber").alias("estimator"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("day"),
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    g = K.consensus(estimates(spark, d), ["company", "period"], "value", "analyst", "estimator", ["day"])
    return K.with_change_labels(g, ["company"], [F.col("period")])


def _dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with blanks and nulls where the rule below puts them."""
    o = T(spark, d, "orders")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        F.when(F.col("o_orderkey") % 13 == 0, "1999-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"),
    )


_DIRTY = """o as (select o_orderkey, case when o_orderkey % 7 = 0 then '  ' else ' ' || lower(o_orderpriority) || ' ' end as priority, nullif(o_orderstatus, 'P') as status,
  case when o_orderkey % 11 = 0 then 'n/a' else cast(o_totalprice as varchar) end as price_text,
  case when o_orderkey % 13 = 0 then '1999-02-30' else strftime(o_orderdate, '%Y-%m-%d') end as date_text from orders)"""


def clean_text_norm(spark, d):
    x = C.clean_columns(_dirty_orders(spark, d), ["priority", "status"])
    return x.select("o_orderkey", F.upper("priority").alias("priority_norm"), F.coalesce("status", F.lit("P")).alias("status_norm"))


def safe_casts(spark, d):
    x = _dirty_orders(spark, d)
    return x.select("o_orderkey", F.round(C.safe_number(F.col("price_text")), 2).alias("price"), C.safe_number(F.col("priority"), "int").alias("bad_int"), F.date_format(C.safe_date(F.col("date_text")), "yyyy-MM-dd").alias("day"))


def identifier_prefix(spark, d):
    return T(spark, d, "part").select("p_partkey", C.id_prefix(F.col("p_name")).alias("name8"), C.composite_key(F.col("p_brand"), F.nullif("p_type", F.lit("ECONOMY")), F.col("p_size")).alias("part_key"))


def fallback_coalesce(spark, d):
    x = C.clean_columns(_dirty_orders(spark, d), ["priority", "status"])
    return x.select("o_orderkey", F.coalesce("status", "priority", "date_text").alias("company_key"))


def funnel_counts(spark, d):
    x = _dirty_orders(spark, d)
    return P.funnel_counts(x, {"with_status": F.col("status").isNotNull(), "with_priority": C.blank_to_null(F.col("priority")).isNotNull(), "numeric_price": C.safe_number(F.col("price_text")).isNotNull(), "with_day": C.safe_date(F.col("date_text")).isNotNull()})


def silver_filter(spark, d):
    x = _dirty_orders(spark, d).withColumns({"price": C.safe_number(F.col("price_text")), "day": C.safe_date(F.col("date_text"))})
    return x.where((F.coalesce("status", F.lit("O")) == "O") & F.col("price").isNotNull() & F.col("day").isNotNull()).select("o_orderkey", F.round("price", 2).alias("price"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def dedup_latest(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    rest = [F.col(c) for c in ALL_LINE if c not in keys and c != "l_shipdate"]
    x = K.latest_per_key(T(spark, d, "lineitem"), keys, [F.desc("l_shipdate"), *rest])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"))


def dedup_stats(spark, d):
    return K.dedup_stats(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def renamed_union(spark, d):
    a = T(spark, d, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = T(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "party_key", "s_name": "party_name"}).select("party_key", "party_name", F.lit("supplier").alias("kind"))
    return union_all([a, b], missing=True)


def null_profile(spark, d):
    return P.null_rates(_dirty_orders(spark, d))


def date_ranges(spark, d):
    x = T(spark, d, "orders").select("o_orderdate")
    return P.date_ranges(x, ["o_orderdate"])


def distinct_ids(spark, d):
    return P.distinct_counts(T(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


def manifest_profile(spark, d):
    return P.manifest(T(spark, d, "orders"), ["o_orderdate"]).select("column_name", "rows", "null_rate", "first_day", "last_day")


def events_profile(spark, d):
    return P.null_rates(T(spark, d, "ibes_gold_events_sample"))


def top_share(spark, d):
    return P.top_share(T(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year")), ["priority", "customer", "year"])


def entropy_bits(spark, d):
    return P.entropy_bits(T(spark, d, "ibes_gold_events_sample"), ["ticker", "event_date", "label_direction"])


def frequency_counts(spark, d):
    return P.frequency(T(spark, d, "ibes_pipeline"), ["split", "source", "direction_label", "magnitude_bucket"])


def length_summary(spark, d):
    return P.length_summary(T(spark, d, "documents").where("source is not null"), ["source"], "text")


def nearest_rank_pct(spark, d):
    return P.nearest_rank(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95])


def mix_proportions(spark, d):
    from skarn.functions.keys import folded

    x = T(spark, d, "documents").select(F.coalesce(folded(F.col("source")), F.lit("unknown")).alias("source"))
    total = x.agg(F.count(F.lit(1))).scalar()
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", F.round(F.col("n") / total, 4).alias("share"))


_ROUND = ["consensus_mean", "consensus_std", "consensus_delta", "consensus_pct_change", "prior_consensus_mean"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _ROUND if c in df.columns}).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def consensus_agg(spark, d):
    return _rounded(K.consensus(estimates(spark, d), ["company", "period"], "value", "analyst", "estimator", ["day"])).withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


def consensus_labels(spark, d):
    return _rounded(gold(spark, d)).select("company", "period", "consensus_median", "prior_consensus_median", "prior_consensus_mean", "consensus_delta", "consensus_pct_change", "direction_label", "magnitude_bucket")


def label_counts(spark, d):
    return K.label_counts(gold(spark, d))


QUERIES = {f.__name__: f for f in (
    clean_text_norm, safe_casts, identifier_prefix, fallback_coalesce, funnel_counts, silver_filter, dedup_latest, dedup_stats, renamed_union, null_profile, date_ranges, distinct_ids,
    manifest_profile, events_profile, top_share, entropy_bits, frequency_counts, length_summary, nearest_rank_pct, mix_proportions, consensus_agg, consensus_labels, label_counts,
)}

_EST = "est as (select l_suppkey as company, cast(date_trunc('month', l_shipdate) as date) as period, l_partkey as analyst, l_linenumber as estimator, l_extendedprice as value, cast(l_shipdate as date) as day from lineitem)"
_CONS = f"""{_EST}, cons as (select company, period, count(*) as estimate_count, count(distinct analyst) as analyst_count, count(distinct estimator) as estimator_count, avg(value) as consensus_mean,
  quantile_disc(value, 0.5) as consensus_median, stddev_samp(value) as consensus_std, min(value) as consensus_min, max(value) as consensus_max, min(day) as first_day from est group by company, period)"""
GOLD_SQL = f"""{_CONS}, lagged as (select *, lag(consensus_median) over w as prior_consensus_median, lag(consensus_mean) over w as prior_consensus_mean from cons window w as (partition by company order by period)),
gold as (select *, consensus_median - prior_consensus_median as consensus_delta,
  case when abs(prior_consensus_median) >= 1e-9 then (consensus_median - prior_consensus_median) / abs(prior_consensus_median) end as consensus_pct_change from lagged),
labelled as (select *, case when consensus_delta is null or abs(consensus_delta) < 0.005 then 'neutral' when consensus_delta > 0 then 'positive' else 'negative' end as direction_label,
  case when consensus_delta is null then 'unknown' when abs(consensus_delta) < 0.005 then 'flat'
    when consensus_pct_change is not null then case when abs(consensus_pct_change) < 0.05 then 'small' when abs(consensus_pct_change) < 0.15 then 'medium' else 'large' end
    when abs(consensus_delta) < 0.05 then 'small' when abs(consensus_delta) < 0.25 then 'medium' else 'large' end as magnitude_bucket from gold)"""


def _null_sql(name: str, columns: list[str], texts: set[str]) -> str:
    one = lambda c: f"select '{c}' as column_name, count(*) as rows, coalesce(round(avg(case when {c} is null{f" or trim({c}) = ''" if c in texts else ''} then 1.0 else 0.0 end), 6), 0.0) as null_rate from {name}"
    return " union all ".join(map(one, columns))


_EVENT_COLUMNS = ["event_id", "event_date", "gvkey", "cusip", "ticker", "label_direction", "label_magnitude", "headline"]
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _freq_sql(name: str, dims: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' as dimension, coalesce(cast({v} as varchar), 'UNK') as value, count(*) as n from {name} group by 1, 2" for k, v in dims.items())


SQL = {
    "clean_text_norm": f"with {_DIRTY} select o_orderkey, upper(nullif(trim(priority), '')) as priority_norm, coalesce(nullif(trim(status), ''), 'P') as status_norm from o",
    "safe_casts": f"with {_DIRTY} select o_orderkey, round(try_cast(price_text as double), 2) as price, try_cast(priority as integer) as bad_int, strftime(try_cast(date_text as date), '%Y-%m-%d') as day from o",
    "identifier_prefix": "select p_partkey, upper(substr(p_name, 1, 8)) as name8, coalesce(p_brand, 'UNK') || '|' || coalesce(nullif(p_type, 'ECONOMY'), 'UNK') || '|' || coalesce(cast(p_size as varchar), 'UNK') as part_key from part",
    "fallback_coalesce": f"with {_DIRTY} select o_orderkey, coalesce(nullif(trim(status), ''), nullif(trim(priority), ''), date_text) as company_key from o",
    "funnel_counts": f"""with {_DIRTY}, c as (select status is not null as a, trim(priority) <> '' as b, try_cast(price_text as double) is not null as p, try_cast(date_text as date) is not null as t from o)
select count(*) as rows_in, count(*) filter (a) as with_status, count(*) filter (b) as with_priority, count(*) filter (p) as numeric_price, count(*) filter (t) as with_day, count(*) filter (a and b and p and t) as rows_kept from c""",
    "silver_filter": f"with {_DIRTY} select o_orderkey, round(try_cast(price_text as double), 2) as price, strftime(try_cast(date_text as date), '%Y-%m-%d') as day from o where coalesce(status, 'O') = 'O' and try_cast(price_text as double) is not null and try_cast(date_text as date) is not null",
    "dedup_latest": """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') as ship_day from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as rn from lineitem) where rn = 1""",
    "dedup_stats": "select count(*) as rows_in, count(distinct (l_orderkey, l_linenumber)) as rows_out, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates_removed from lineitem",
    "renamed_union": "select c_custkey as party_key, c_name as party_name, 'customer' as kind, c_mktsegment as segment from customer union all select s_suppkey, s_name, 'supplier', null from supplier",
    "null_profile": f"with {_DIRTY} {_null_sql('o', ['o_orderkey', 'priority', 'status', 'price_text', 'date_text'], {'priority', 'status', 'price_text', 'date_text'})}",
    "date_ranges": "select 'o_orderdate' as column_name, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day, count(*) as rows from orders",
    "distinct_ids": " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as distinct_values, count(*) as rows from lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey")),
    "manifest_profile": "select p.*, case when column_name = 'o_orderdate' then (select strftime(min(o_orderdate), '%Y-%m-%d') from orders) end as first_day, case when column_name = 'o_orderdate' then (select strftime(max(o_orderdate), '%Y-%m-%d') from orders) end as last_day from ("
    + _null_sql("orders", _ORDER_COLUMNS, {"o_orderstatus", "o_orderpriority"})
    + ") p",
    "events_profile": _null_sql("ibes_gold_events_sample", _EVENT_COLUMNS, set(_EVENT_COLUMNS) - {"event_date"}),
    "top_share": f"""with f as ({_freq_sql("orders", {"priority": "o_orderpriority", "customer": "o_custkey", "year": "year(o_orderdate)"})}), t as (select count(*) as total from orders),
r as (select *, row_number() over (partition by dimension order by n desc, value) as rn from f) select dimension, value, n, round(n / total, 4) as share from r, t where rn <= 10""",
    "entropy_bits": f"""with f as ({_freq_sql("ibes_gold_events_sample", {c: c for c in ("ticker", "event_date", "label_direction")})})
select dimension, count(*) as distinct_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) as entropy from f group by dimension""",
    "frequency_counts": _freq_sql("ibes_pipeline", {c: c for c in ("split", "source", "direction_label", "magnitude_bucket")}),
    "length_summary": "select source, round(avg(length(text)), 2) as mean_chars, cast(min(length(text)) as integer) as min_chars, cast(max(length(text)) as integer) as max_chars from documents where source is not null group by source",
    "nearest_rank_pct": """with r as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, max(n) as n, max(v) filter (i = round_even((n - 1) * 0.5, 0)) as p50, max(v) filter (i = round_even((n - 1) * 0.95, 0)) as p95 from r group by l_returnflag""",
    "mix_proportions": "select coalesce(nullif(lower(trim(source)), ''), 'unknown') as source, count(*) as n, round(count(*) / (select count(*) from documents), 4) as share from documents group by 1",
    "consensus_agg": f"with {_CONS} select * replace (round(consensus_mean, 6) as consensus_mean, round(consensus_std, 6) as consensus_std, strftime(period, '%Y-%m-%d') as period, strftime(first_day, '%Y-%m-%d') as first_day) from cons",
    "consensus_labels": f"""with {GOLD_SQL} select company, strftime(period, '%Y-%m-%d') as period, consensus_median, prior_consensus_median, round(prior_consensus_mean, 6) as prior_consensus_mean, round(consensus_delta, 6) as consensus_delta,
  round(consensus_pct_change, 6) as consensus_pct_change, direction_label, magnitude_bucket from labelled""",
    "label_counts": f"""with {GOLD_SQL} select count(*) as event_rows, count(prior_consensus_median) as rows_with_prior, count(*) filter (direction_label = 'positive') as positive_labels,
  count(*) filter (direction_label = 'negative') as negative_labels, count(*) filter (direction_label = 'neutral') as neutral_labels from labelled""",
}
