"""The staged pipeline on an extract made from the domain tables: an estimate per analyst event, in the raw layout, with
figures and flaws that follow from the event's id; daily returns, benchmark and stock header from their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.plans import pipeline as Pl
from skarn.plans.links import events_with_permno, usable_links
from skarn.session import cut
from skarn.sources.tables import table as T

CONFIG = Pl.PipelineConfig("", "", train_eval=50, sample=100)


def raw_estimates(spark: SparkSession, d: str) -> DataFrame:
    ev = T(spark, d, "ibes_gold_events_sample").where("event_date is not null")
    p = events_with_permno(ev, usable_links(spark, d)).select(F.col("event_id").alias("i"), "permno")
    x = ev.join(p, F.col("event_id") == F.col("i"), "left").withColumn("h", F.conv(F.substring(F.md5("event_id"), 1, 7), 16, 10).cast("long"))
    h, month = F.col("h"), F.date_format(F.trunc("event_date", "month"), "yyyy-MM-dd")
    when = lambda m, v: F.when(h % m == 0, v)
    return x.select(
        F.col("ticker").alias("TICKER"), F.concat(F.lpad(F.col("permno").cast("string"), 8, "0"), F.lit("x")).alias("CUSIP"), F.col("ticker").alias("OFTIC"), F.concat(F.lit("company "), F.col("permno").cast("string")).alias("CNAME"),
        month.alias("ACTDATS"), F.concat(F.lit("e"), h % 5).alias("ESTIMATOR"), F.concat(F.lit(" a"), h % 23).alias("ANALYS"), when(9, "P").otherwise(when(3, "C")).alias("CURRFL"), F.lit("D").alias("PDF"),
        (h % 3 + 1).cast("string").alias("FPI"), when(17, "SAL").otherwise("eps").alias("MEASURE"), when(19, "n/a").otherwise(F.concat((F.expr("h div 1000") % 4).cast("string"), F.lit("."), F.lpad((h % 1000).cast("string"), 3, "0"))).alias("VALUE"),
        F.lit("USD").alias("CURR"), when(13, "0").otherwise("1").alias("USFIRM"), F.concat(F.year("event_date").cast("string"), F.lit("-12-31")).alias("FPEDATS"), F.lit("09:00:00").alias("ACTTIMS"), when(29, "bad").otherwise(month).alias("REVDATS"),
        F.lit("10:00:00").alias("REVTIMS"), month.alias("ANNDATS"), F.lit("11:00:00").alias("ANNTIMS"), when(7, "EUR").alias("report_curr"),
    )


def raw_daily(spark: SparkSession, d: str) -> DataFrame:
    """Securities with an even number carry their identifier; the others are found through the header."""
    x, text = T(spark, d, "crsp_daily_returns_sample"), lambda c: F.col(c).cast("string")
    cusip = F.when(F.col("permno") % 2 == 0, F.lpad(text("permno"), 8, "0"))
    return x.select(text("permno").alias("PERMNO"), text("date").alias("date"), cusip.alias("CUSIP"), F.lit(None).cast("string").alias("NCUSIP"), F.lit("").alias("TICKER"), text("prc").alias("PRC"), text("vol").alias("VOL"), text("ret").alias("RET"), text("shrout").alias("SHROUT"))


def raw_header(spark: SparkSession, d: str) -> DataFrame:
    x, text = T(spark, d, "crsp_compustat_link_sample"), lambda c: F.col(c).cast("string")
    return x.select(text("permno").alias("PERMNO"), F.concat(F.lpad(text("permno"), 8, "0"), F.lit("X")).alias("CUSIP"), F.lit(" ").alias("HTSYMBOL"), F.lit(None).cast("string").alias("HTICK"), text("linkdt").alias("BEGDAT"), text("linkenddt").alias("ENDDAT"))


def raw_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("benchmark_return").cast("string")
    return T(spark, d, "market_benchmark_returns_sample").select(F.col("date").cast("string").alias("DATE"), F.lit("0.5").alias("ewretd"), b.alias("vwretd"))


def _silver(spark: SparkSession, d: str) -> DataFrame:
    return Pl.silver(Pl.bronze(raw_estimates(spark, d)))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return Pl.gold(_silver(spark, d))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    # a stage's table, as the pipeline would keep it
    return cut(Pl.panel(_gold(spark, d), Pl.daily_silver(raw_daily(spark, d)), Pl.benchmark_bronze(raw_benchmark(spark, d)), CONFIG, Pl.header_silver(raw_header(spark, d))))


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def staged_bronze(spark, d):
    x = Pl.bronze(raw_estimates(spark, d))
    return x.groupBy("measure_norm", "usfirm_flag", "currfl_norm", "report_currency_norm").agg(F.count(F.lit(1)).alias("n"), F.count("VALUE").alias("valued"), F.count_distinct("company_key").alias("companies"), F.count("REVDATS").alias("revised"), F.count_distinct("cusip8").alias("cusips"))


def staged_silver(spark, d):
    return _silver(spark, d).select("company_key", "cusip8", "company_name_norm", "analyst_id", "estimator_id", "FPI", _day("fiscal_period_end_date"), _day("event_date"), "event_time", F.round("estimate_value", 4).alias("estimate_value"))


def staged_gold(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _gold(spark, d).select("event_id", "cusip8", "estimate_count", "analyst_count", "estimator_count", *map(r, Pl.FIGURES), "direction_label", "magnitude_bucket")


def staged_panel(spark, d):
    return _panel(spark, d).select(
        "event_id", "cusip8", "security", _day("anchor_day"), "join_method", "join_confidence", "join_status", F.round("raw_return_w_p0_p1", 6).alias("raw_return"), F.round("abnormal_return_w_p0_p1", 6).alias("abnormal_return"), "obs_count_w_p0_p1",
        "realized_direction_label", "realized_magnitude_bucket", "alignment_label",
    )


def staged_records(spark, d):
    return Pl.records(_panel(spark, d), CONFIG).select("split", "event_id", "source", F.get_json_object("input", "$.company.cusip8").alias("cusip8"), F.get_json_object("input", "$.event.event_date").alias("event_date"), F.get_json_object("input", "$.features.estimate_count").cast("long").alias("estimate_count"), "output")


def staged_chats(spark, d):
    last = F.element_at("messages", -1)
    return Pl.chats(_panel(spark, d), CONFIG).select("split", "event_id", "event_date", F.size("messages").alias("turns"), last["role"].alias("role"), (last["content"] == F.col("output")).alias("same"), F.get_json_object("input", "$.event.join_method").alias("join_method"), "output", "realized_direction_label")


def staged_validation(spark, d):
    """Faults by kind; every kind is listed, and a clean set of records has none."""
    e = Pl.validation(Pl.chats(_panel(spark, d), CONFIG))
    kind = F.when(F.col("error").startswith("missing keys"), "missing keys").otherwise(F.col("error"))
    kinds = spark.createDataFrame([(k,) for k in ("empty input", "missing assistant message", "output mismatch", "invalid json", "missing keys", "stands in several splits")], "error string")
    return kinds.join(e.groupBy(kind.alias("error")).agg(F.count(F.lit(1)).alias("n")), "error", "left").select("error", F.coalesce("n", F.lit(0)).alias("n"))


def benchmark_column(spark, d):
    return Pl.benchmark_bronze(raw_benchmark(spark, d)).select(_day("trade_date"), F.round("benchmark_return", 8).alias("benchmark_return"))


def presence_days(spark, d):
    return Pl.presence_bronze(raw_daily(spark, d)).groupBy("permno").agg(F.count(F.lit(1)).alias("days"), F.date_format(F.min("presence_date"), "yyyy-MM-dd").alias("first_day"))


def daily_prices(spark, d):
    """Cleaned daily rows: absolute price, upper-case identifiers, index of the trading day."""
    return Pl.daily_silver(raw_daily(spark, d)).select("permno", _day("trade_date"), "cusip8", "ticker_norm", F.round("price", 4).alias("price"), F.round("ret", 8).alias("ret"), "trade_idx")


def header_entries(spark, d):
    """Cleaned header rows; the ticker is the trading symbol, or the header's ticker where that is blank."""
    raw = raw_header(spark, d).withColumns({"HTSYMBOL": F.when(F.col("PERMNO").cast("int") % 3 == 0, F.concat(F.lit(" s"), "PERMNO")).otherwise(F.lit("  ")), "HTICK": F.concat(F.lit("t"), "PERMNO", F.lit(" "))})
    return Pl.header_silver(raw).select("permno", "cusip8", "header_ticker", _day("beg_date"), _day("end_date"))


def prior_present(spark, d):
    return _gold(spark, d).where("prior_consensus_median is not null").groupBy("direction_label", "magnitude_bucket").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (staged_bronze, staged_silver, staged_gold, staged_panel, staged_records, staged_chats, staged_validation, benchmark_column, presence_days, daily_prices, header_entries, prior_present)}

_LINKED = """lk as (select ltrim(trim(gvkey), '0') as k, permno, linkdt, coalesce(linkenddt, date '9999-12-31') as fin from crsp_compustat_link_sample where permno is not null and linkdt is not null and gvkey is not null and linkdt <= coalesce(linkenddt, date '9999-12-31')),
pm as (select event_id, permno from (select event_id, permno, row_number() over (partition by event_id order by linkdt desc, permno) as rn from ibes_gold_events_sample g join lk on ltrim(trim(g.gvkey), '0') = lk.k and g.event_date between lk.linkdt and lk.fin) where rn = 1)"""
_RAW = f"""{_LINKED},
ra as (select e.*, permno, ('0x' || substr(md5(e.event_id), 1, 7))::bigint as h, date_trunc('month', event_date)::date as month from ibes_gold_events_sample e left join pm using (event_id) where event_date is not null),
br as (select upper(nullif(trim(ticker), '')) as company, lpad(permno::varchar, 8, '0') as cusip8, 'COMPANY ' || permno as name, 'e' || h % 5 as estimator, 'a' || h % 23 as analyst, case when h % 9 = 0 then 'P' when h % 3 = 0 then 'C' end as currfl,
  (h % 3 + 1)::varchar as fpi, case when h % 17 = 0 then 'SAL' else 'EPS' end as measure, case when h % 19 <> 0 then (((h // 1000) % 4)::varchar || '.' || lpad((h % 1000)::varchar, 3, '0'))::double end as v, case when h % 13 = 0 then 0 else 1 end as us,
  make_date(year(event_date), 12, 31) as fp, case when h % 29 <> 0 then month end as rev, month as day, case when h % 7 = 0 then 'EUR' end as cur from ra),
si as (select distinct coalesce(company, cusip8) as company_key, company, cusip8, name, analyst, estimator, fpi, fp, day, v from br
  where measure = 'EPS' and us = 1 and coalesce(currfl, 'C') = 'C' and coalesce(cur, 'USD') = 'USD' and v is not null and coalesce(company, cusip8) is not null),
go as (select company_key, company, cusip8, name, fpi, fp, day, count(*) as estimate_count, count(distinct analyst) as analyst_count, count(distinct estimator) as estimator_count, avg(v) as consensus_mean, quantile_disc(v, 0.5) as consensus_median, stddev_samp(v) as consensus_std,
  min(v) as consensus_min, max(v) as consensus_max from si group by all),
gp as (select *, lag(consensus_mean) over w as prior_consensus_mean, lag(consensus_median) over w as prior_consensus_median from go window w as (partition by company_key, fpi, fp order by day, coalesce(company, ''), company_key, company nulls first, cusip8 nulls first, name nulls first)),
gd as (select *, consensus_median - prior_consensus_median as consensus_delta, case when abs(prior_consensus_median) >= 1e-9 then (consensus_median - prior_consensus_median) / abs(prior_consensus_median) end as consensus_pct_change,
  company_key || '|' || strftime(day, '%Y-%m-%d') || '|' || fpi || '|' || strftime(fp, '%Y-%m-%d') as event_id from gp),
gl as (select *, case when consensus_delta is null or abs(consensus_delta) < 0.005 then 'neutral' when consensus_delta > 0 then 'positive' else 'negative' end as direction_label,
  case when consensus_delta is null then 'unknown' when abs(consensus_delta) < 0.005 then 'flat' when consensus_pct_change is not null then case when abs(consensus_pct_change) < 0.05 then 'small' when abs(consensus_pct_change) < 0.15 then 'medium' else 'large' end
    when abs(consensus_delta) < 0.05 then 'small' when abs(consensus_delta) < 0.25 then 'medium' else 'large' end as magnitude_bucket from gd)"""


def _panel_sql() -> str:
    from skarn.plans.market import _comp, _frame

    n = "w"
    return f"""{_RAW},
du as (select permno, date, case when permno % 2 = 0 then lpad(permno::varchar, 8, '0') end as cusip8, ret, abs(prc) as price, row_number() over (partition by permno, date order by ret, abs(prc) nulls last) as rn from crsp_daily_returns_sample where ret is not null and permno is not null and date is not null),
mb as (select date, min(benchmark_return) as bench from market_benchmark_returns_sample where benchmark_return is not null group by date),
ds as (select permno, date, cusip8, price, ret, bench, row_number() over (partition by permno order by date) as trade_idx from du left join mb using (date) where rn = 1),
dw as (select *, {_comp('ret', n)} as raw, {_comp('bench', n)} as mark, count(ret) over {n} as obs from ds window {n} as {_frame('permno', '0:1')}),
ba as (select * from (select *, row_number() over (partition by event_id order by coalesce(company, ''), coalesce(cusip8, ''), coalesce(name, '')) as rn from gl where prior_consensus_median is not null) where rn = 1),
ca as (select event_id, date, permno, 'cusip8' as m, 0.95 as c from ba join ds on ds.cusip8 = ba.cusip8 and date between day and day + 7
  union all select event_id, date, ds.permno, 'cusip8_header', 0.7 from ba join (select distinct permno, lpad(permno::varchar, 8, '0') as c8, linkdt, linkenddt from crsp_compustat_link_sample where permno is not null and linkdt is not null) hd
    on hd.c8 = ba.cusip8 and day >= linkdt and (linkenddt is null or day <= linkenddt) join ds on ds.permno = hd.permno and date between day and day + 7),
be as (select * from (select *, row_number() over (partition by event_id order by c desc, date, permno, m) as rn from ca) where rn = 1),
pa as (select ba.*, be.permno as security, be.date as anchor_day, coalesce(m, 'none') as join_method, coalesce(c, 0.0)::double as join_confidence, case when m is null then 'unmatched' else 'matched' end as join_status, raw, raw - mark as abnormal, coalesce(obs, 0) as obs
  from ba left join be using (event_id) left join dw on dw.permno = be.permno and dw.date = be.date),
pl as (select *, case when coalesce(abnormal, raw) is null then 'unknown' when abs(coalesce(abnormal, raw)) < 0.01 then 'neutral' when coalesce(abnormal, raw) > 0 then 'positive' else 'negative' end as realized,
  case when coalesce(abnormal, raw) is null then 'unknown' when abs(coalesce(abnormal, raw)) < 0.01 then 'flat' when abs(coalesce(abnormal, raw)) < 0.05 then 'small' else 'large' end as size from pa),
pn as (select *, case when realized = 'unknown' then 'unobserved' when direction_label = realized then 'aligned' when direction_label = 'neutral' or realized = 'neutral' then 'mixed' else 'contrarian' end as alignment from pl),
sp as (select *, case when pr < 0.9 then 'train' when pr < 0.9 + 0.05 then 'val' else 'test' end as split from (select *, percent_rank() over (order by day, event_id) as pr from pn))"""


_PANEL = _panel_sql()
_ANSWER = """'{"alignment":"' || alignment || '","direction":"' || direction_label || '","event_type":"ibes_analyst_revision_consensus","magnitude":"' || magnitude_bucket || '"}'"""
_HASH = lambda seed: f"md5(event_id || '#{seed}')"

SQL = {
    "staged_bronze": f"with {_RAW} select measure as measure_norm, us as usfirm_flag, currfl as currfl_norm, cur as report_currency_norm, count(*) as n, count(v) as valued, count(distinct coalesce(company, cusip8)) as companies, count(rev) as revised, count(distinct cusip8) as cusips from br group by all",
    "staged_silver": f"with {_RAW} select company_key, cusip8, name as company_name_norm, analyst as analyst_id, estimator as estimator_id, fpi as FPI, strftime(fp, '%Y-%m-%d') as fiscal_period_end_date, strftime(day, '%Y-%m-%d') as event_date, '10:00:00' as event_time, round(v, 4) as estimate_value from si",
    "staged_gold": f"with {_RAW} select event_id, cusip8, estimate_count, analyst_count, estimator_count, " + ", ".join(f"round({c}, 6) as {c}" for c in Pl.FIGURES) + ", direction_label, magnitude_bucket from gl",
    "staged_panel": f"""with {_PANEL} select event_id, cusip8, security, strftime(anchor_day, '%Y-%m-%d') as anchor_day, join_method, join_confidence, join_status, round(raw, 6) as raw_return, round(abnormal, 6) as abnormal_return, obs as obs_count_w_p0_p1,
  realized as realized_direction_label, size as realized_magnitude_bucket, alignment as alignment_label from pn""",
    "staged_records": f"""with {_PANEL} select split, event_id, 'estimates' as source, cusip8, strftime(day, '%Y-%m-%d') as event_date, estimate_count, '{{"direction_label":"' || direction_label || '","event_type":"ibes_analyst_revision_consensus","magnitude_bucket":"' || magnitude_bucket || '"}}' as output from sp""",
    "staged_chats": f"""with {_PANEL}, ch as (select *, split as s from sp union all (select *, 'train_eval' from sp where split = 'val' order by {_HASH(92)}, event_id limit 50) union all (select *, 'sample_100' from sp where split = 'train' order by {_HASH(142)}, event_id limit 100))
select s as split, event_id, strftime(day, '%Y-%m-%d') as event_date, 3 as turns, 'assistant' as role, true as same, join_method, {_ANSWER} as output, realized as realized_direction_label from ch""",
    "staged_validation": "select unnest(['empty input', 'missing assistant message', 'output mismatch', 'invalid json', 'missing keys', 'stands in several splits']) as error, 0 as n",
    "benchmark_column": "select strftime(date, '%Y-%m-%d') as trade_date, round(min(benchmark_return), 8) as benchmark_return from market_benchmark_returns_sample where benchmark_return is not null and date is not null group by date",
    "presence_days": "select permno, count(distinct date) as days, strftime(min(date), '%Y-%m-%d') as first_day from crsp_daily_returns_sample where permno is not null and date is not null group by permno",
    "daily_prices": f"with {_PANEL} select permno, strftime(date, '%Y-%m-%d') as trade_date, cusip8, '' as ticker_norm, round(price, 4) as price, round(ret, 8) as ret, trade_idx from ds",
    "header_entries": """select distinct permno, lpad(permno::varchar, 8, '0') as cusip8, case when permno % 3 = 0 then 'S' || permno else 'T' || permno end as header_ticker, strftime(linkdt, '%Y-%m-%d') as beg_date, strftime(linkenddt, '%Y-%m-%d') as end_date
from crsp_compustat_link_sample where permno is not null and linkdt is not null""",
    "prior_present": f"with {_RAW} select direction_label, magnitude_bucket, count(*) as n from gl where prior_consensus_median is not null group by all",
}
