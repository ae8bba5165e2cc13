"""Daily series, entity resolution, event windows and label alignment. Users of the event stream stand in for
securities (price = mean value of a day) and purchases for events; the windows also run on the daily and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import clean as C
from skarn.operators import resolve as R
from skarn.operators import returns as W
from skarn.operators.consensus import latest_per_key
from skarn.plans.links import events_with_permno, usable_links
from skarn.sources.tables import table as T

WINDOWS = ["0:1", "0:3", "0:5", "-1:1"]
#: Edges for labels on the stand-in series, whose returns are large.
EDGE, LARGE = 0.1, 0.5


def day_series(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("security").orderBy("day")
    p = T(spark, d, "events").groupBy(F.col("user_id").alias("security"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("price"))
    p = p.withColumn("ret", F.col("price") / F.nullif(F.lag("price").over(w), F.lit(0.0)) - 1).where("ret is not null")
    return W.trade_index(p, "security", [F.col("day")])


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("event_day"), "value")


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Per user the days between first and last error, open-ended for every third user."""
    e = T(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("header_user")).agg(F.min(F.to_date("ts")).alias("beg"), F.max(F.to_date("ts")).alias("fin"))
    return e.withColumn("fin", F.when(F.col("header_user") % 3 != 0, F.col("fin")))


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def trade_index(spark, d):
    return day_series(spark, d).select("security", _day("day").alias("day"), "trade_idx", F.round("ret", 6).alias("ret"))


def range_join_7d(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("order_day"))
    i = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("ship_day"), "l_linenumber", "l_partkey")
    x = R.forward_range_join(o, i, ["k"], "order_day", "ship_day", 7)
    return x.select(F.col("k").alias("o_orderkey"), "l_linenumber", "l_partkey", _day("order_day").alias("order_day"), _day("ship_day").alias("ship_day"))


def interval_join(spark, d):
    h = headers(spark, d).withColumnRenamed("header_user", "user_id")
    return R.interval_join(purchases(spark, d), h, ["user_id"], "event_day", "beg", "fin").select("event_id", "user_id", _day("event_day").alias("event_day"))


def offset_range_join(spark, d):
    """Relative days -1 to 5 around an anchor, as rows."""
    days = day_series(spark, d).select("security", "trade_idx", F.round("ret", 6).alias("ret"))
    anchors = purchases(spark, d).join(day_series(spark, d).select(F.col("security").alias("user_id"), F.col("day").alias("event_day"), F.col("trade_idx").alias("anchor")), ["user_id", "event_day"])
    x = anchors.select("event_id", F.col("user_id").alias("security"), "anchor", F.explode(F.sequence(F.col("anchor") - 1, F.col("anchor") + 5)).alias("trade_idx"))
    return x.join(days, ["security", "trade_idx"]).select("event_id", (F.col("trade_idx") - F.col("anchor")).alias("relative_day"), "ret")


def _resolution(spark: SparkSession, d: str) -> DataFrame:
    """Purchases meet series by three identifiers of falling confidence, one of them only inside a dated header."""
    ev = purchases(spark, d)
    hit = R.interval_join(ev, headers(spark, d).withColumnRenamed("header_user", "user_id"), ["user_id"], "event_day", "beg", "fin").select("event_id", F.lit(True).alias("in_header"))
    ev = ev.join(hit, "event_id", "left")
    u = F.col("user_id")
    keys = R.event_keys(ev, "event_id", "event_day", {
        "primary": (F.when(u % 4 == 0, F.format_string("P%05d", u)), 0.95),
        "alternate": (F.when(u % 2 == 0, F.format_string("A%05d", u)), 0.75),
        "header": (F.when(F.col("in_header"), u.cast("string")), 0.6),
    })
    s = F.col("security")
    sec = R.security_keys(day_series(spark, d), "security", "day", {"primary": F.format_string("P%05d", s), "alternate": F.format_string("A%05d", s), "header": s.cast("string")})
    return R.with_resolution(ev.drop("in_header"), "event_id", R.resolve_first(keys, sec, 3))


def entity_resolution_panel(spark, d):
    return _resolution(spark, d).select("event_id", "security", _day("anchor_day").alias("anchor_day"), "join_method", "join_confidence", "join_status")


def join_method_distribution(spark, d):
    return R.method_distribution(_resolution(spark, d))


def lookup_names(spark, d):
    """Customers with their nation and region; every key must have an entry."""
    n = T(spark, d, "nation").withColumnsRenamed({"n_nationkey": "nation", "n_name": "nation_name", "n_regionkey": "region"})
    r = T(spark, d, "region").withColumnsRenamed({"r_regionkey": "region", "r_name": "region_name"})
    c = T(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return R.lookup(R.lookup(c, n, "nation", required=True), r, "region", required=True).select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("customer"), "nation_name", "region_name")


def left_anti_unmatched(spark, d):
    x = _resolution(spark, d)
    return R.unmatched(purchases(spark, d), x.where("join_status = 'matched'"), "event_id").select("event_id", "user_id")


def _with_bench(spark: SparkSession, d: str) -> DataFrame:
    s = day_series(spark, d)
    bench = s.groupBy("day").agg(F.avg("ret").alias("bench"))
    return s.join(bench, "day", "left")


def event_window_returns(spark, d):
    x = W.window_returns(_with_bench(spark, d), "security", WINDOWS, benchmark="bench").withColumnsRenamed({"security": "user_id", "day": "event_day"})
    slugs = [W.window_slug(w) for w in WINDOWS]
    cols = [F.round(f"{k}_{s}", 6).alias(f"{k}_{s}") for s in slugs for k in ("raw_return", "benchmark_return", "abnormal_return")] + [F.col(f"obs_count_{s}") for s in slugs]
    return purchases(spark, d).join(x, ["user_id", "event_day"]).select("event_id", *cols)


def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows with a return, one per security and day: of repeated rows the least figures, compared in order."""
    x = T(spark, d, "crsp_daily_returns_sample").where("ret is not null and permno is not null and date is not null")
    x = latest_per_key(x, ["permno", "date"], [F.asc_nulls_last(c) for c in ("ret", "prc", "shrout", "vol")])
    return W.trade_index(x.withColumn("price", F.abs("prc")), "permno", [F.col("date")])


def _market_windows(spark: SparkSession, d: str) -> DataFrame:
    bench = T(spark, d, "market_benchmark_returns_sample").groupBy("date").agg(F.min("benchmark_return").alias("bench"))
    x = W.window_returns(daily_returns(spark, d).join(bench, "date", "left"), "permno", WINDOWS, benchmark="bench")
    ev = events_with_permno(T(spark, d, "ibes_gold_events_sample"), usable_links(spark, d)).select("event_id", "permno", "event_date")
    first = R.forward_range_join(ev, x.select("permno", F.col("date").alias("anchor_date")), ["permno"], "event_date", "anchor_date", 7).groupBy("event_id", "permno").agg(F.min("anchor_date").alias("date"))
    return first.join(x, ["permno", "date"])


def market_event_windows(spark, d):
    slugs = [W.window_slug(w) for w in WINDOWS]
    cols = [F.round(f"{k}_{s}", 5).alias(f"{k}_{s}") for s in slugs for k in ("raw_return", "benchmark_return", "abnormal_return")]
    return _market_windows(spark, d).select("event_id", "permno", _day("date").alias("anchor_date"), *cols, *[F.col(f"obs_count_{s}") for s in slugs])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    x = W.window_returns(_with_bench(spark, d), "security", ["0:1"], benchmark="bench").withColumnsRenamed({"security": "user_id", "day": "event_day"})
    ev = purchases(spark, d).join(x, ["user_id", "event_day"], "left")
    ret = F.coalesce("abnormal_return_w_p0_p1", "raw_return_w_p0_p1")
    ev = ev.withColumns({"reaction": ret, "expected": F.when(F.col("value") > 60, "positive").when(F.col("value") < 20, "negative").otherwise("neutral")})
    ev = ev.withColumns({"realized": C.realized_direction(F.col("reaction"), EDGE), "magnitude": C.realized_magnitude(F.col("reaction"), EDGE, LARGE)})
    return ev.withColumn("alignment", C.alignment(F.col("expected"), F.col("realized")))


def realized_labels(spark, d):
    return _labelled(spark, d).select("event_id", "expected", "realized", "magnitude", "alignment")


def label_alignment(spark, d):
    x = W.label_alignment(_labelled(spark, d), "expected", "reaction")
    return x.select("label", "events", F.round("mean_return", 6).alias("mean_return"), F.round("hit_rate", 6).alias("hit_rate"))


def long_short_spread(spark, d):
    x = W.long_short_spread(_labelled(spark, d), "expected", "reaction")
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


QUERIES = {f.__name__: f for f in (
    trade_index, range_join_7d, interval_join, offset_range_join, entity_resolution_panel, join_method_distribution, left_anti_unmatched, lookup_names, event_window_returns, market_event_windows,
    realized_labels, label_alignment, long_short_spread,
)}

_DAYS = """p as (select user_id as security, cast(ts as date) as day, avg(value) as price from events group by 1, 2),
r as (select *, price / nullif(lag(price) over (partition by security order by day), 0) - 1 as ret from p),
s as (select security, day, ret, row_number() over (partition by security order by day) as trade_idx from r where ret is not null),
e as (select event_id, user_id, cast(ts as date) as event_day, value from events where event_type = 'purchase'),
h as (select user_id, min(cast(ts as date)) as beg, case when user_id % 3 <> 0 then max(cast(ts as date)) end as fin from events where event_type = 'error' group by user_id),
b as (select day, avg(ret) as bench from s group by day)"""


def _comp(col: str, n: str) -> str:
    return f"case when count(*) filter ({col} > -0.999999) over {n} > 0 then exp(sum(case when {col} > -0.999999 then ln(1 + {col}) end) over {n}) - 1 end"


def _frame(key: str, spec: str) -> str:
    s, e = W.parse_window(spec)
    at = lambda x: f"{-x} preceding" if x < 0 else "current row" if x == 0 else f"{x} following"
    return f"(partition by {key} order by trade_idx rows between {at(s)} and {at(e)})"


def _window_sql(source: str, key: str, windows: list[str]) -> str:
    names = {w: W.window_slug(w) for w in windows}
    cols = ", ".join(f"{_comp('ret', n)} as raw_return_{n}, {_comp('bench', n)} as benchmark_return_{n}, count(ret) over {n} as obs_count_{n}" for n in names.values())
    return f"select *, {cols} from {source} window " + ", ".join(f"{n} as {_frame(key, w)}" for w, n in names.items())


_CAND = """ek as (select event_id, event_day, user_id, unnest([{'t': 'primary', 'k': case when user_id % 4 = 0 then printf('P%05d', user_id) end, 'c': 0.95}, {'t': 'alternate', 'k': case when user_id % 2 = 0 then printf('A%05d', user_id) end, 'c': 0.75},
  {'t': 'header', 'k': case when exists (select 1 from h where h.user_id = e.user_id and e.event_day >= h.beg and (h.fin is null or e.event_day <= h.fin)) then cast(user_id as varchar) end, 'c': 0.6}]) as x from e),
cand as (select event_id, security, day, x.t as t, cast(x.c as double) as c, row_number() over (partition by event_id order by x.c desc, day, security) as rn from ek join s
  on x.k = case x.t when 'primary' then printf('P%05d', s.security) when 'alternate' then printf('A%05d', s.security) else cast(s.security as varchar) end and s.day between ek.event_day and ek.event_day + 3 where x.k is not null),
panel as (select e.event_id, e.user_id, security, day as anchor_day, coalesce(t, 'none') as join_method, coalesce(c, 0.0) as join_confidence, case when t is null then 'unmatched' else 'matched' end as join_status
  from e left join (select * from cand where rn = 1) m using (event_id))"""

_LAB = f"""{_DAYS}, sb as (select s.*, bench from s left join b using (day)), w as ({_window_sql("sb", "security", ["0:1"])}),
l as (select event_id, case when value > 60 then 'positive' when value < 20 then 'negative' else 'neutral' end as expected, coalesce(raw_return_w_p0_p1 - benchmark_return_w_p0_p1, raw_return_w_p0_p1) as reaction
  from e left join w on w.security = e.user_id and w.day = e.event_day),
lab as (select *, case when reaction is null then 'unknown' when abs(reaction) < 0.1 then 'neutral' when reaction > 0 then 'positive' else 'negative' end as realized,
  case when reaction is null then 'unknown' when abs(reaction) < 0.1 then 'flat' when abs(reaction) < 0.5 then 'small' else 'large' end as magnitude from l)"""

_SLUGS = [W.window_slug(w) for w in WINDOWS]

SQL = {
    "trade_index": f"with {_DAYS} select security, strftime(day, '%Y-%m-%d') as day, trade_idx, round(ret, 6) as ret from s",
    "range_join_7d": "select o_orderkey, l_linenumber, l_partkey, strftime(o_orderdate, '%Y-%m-%d') as order_day, strftime(l_shipdate, '%Y-%m-%d') as ship_day from orders join lineitem on o_orderkey = l_orderkey and cast(l_shipdate as date) between cast(o_orderdate as date) and cast(o_orderdate as date) + 7",
    "interval_join": f"with {_DAYS} select event_id, e.user_id, strftime(event_day, '%Y-%m-%d') as event_day from e join h on e.user_id = h.user_id and event_day >= beg and (fin is null or event_day <= fin)",
    "offset_range_join": f"with {_DAYS}, a as (select event_id, security, trade_idx as anchor from e join s on s.security = e.user_id and s.day = e.event_day) select event_id, trade_idx - anchor as relative_day, round(ret, 6) as ret from a join s using (security) where trade_idx between anchor - 1 and anchor + 5",
    "entity_resolution_panel": f"with {_DAYS}, {_CAND} select event_id, security, strftime(anchor_day, '%Y-%m-%d') as anchor_day, join_method, join_confidence, join_status from panel",
    "join_method_distribution": f"with {_DAYS}, {_CAND} select join_status, join_method, count(*) as n from panel group by all",
    "lookup_names": "select lpad(cast(c_custkey as varchar), 10, '0') as customer, n_name as nation_name, r_name as region_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "left_anti_unmatched": f"with {_DAYS}, {_CAND} select event_id, user_id from panel where join_status = 'unmatched'",
    "event_window_returns": f"with {_DAYS}, sb as (select s.*, bench from s left join b using (day)), w as ({_window_sql('sb', 'security', WINDOWS)}) select event_id, "
    + ", ".join(f"round(raw_return_{n}, 6) as raw_return_{n}, round(benchmark_return_{n}, 6) as benchmark_return_{n}, round(raw_return_{n} - benchmark_return_{n}, 6) as abnormal_return_{n}, obs_count_{n}" for n in _SLUGS)
    + " from e join w on w.security = e.user_id and w.day = e.event_day",
    "market_event_windows": f"""with l as (select ltrim(trim(gvkey), '0') as k, permno, linkdt, coalesce(linkenddt, date '9999-12-31') as fin from crsp_compustat_link_sample
  where permno is not null and linkdt is not null and gvkey is not null and linkdt <= coalesce(linkenddt, date '9999-12-31')),
ev as (select event_id, event_date, permno, row_number() over (partition by event_id order by linkdt desc, permno) as rn from ibes_gold_events_sample g join l on ltrim(trim(g.gvkey), '0') = l.k and g.event_date between l.linkdt and l.fin),
u as (select permno, date, ret, row_number() over (partition by permno, date order by ret, prc nulls last, shrout nulls last, vol nulls last) as rn from crsp_daily_returns_sample where ret is not null and permno is not null and date is not null),
mb as (select date, min(benchmark_return) as bench from market_benchmark_returns_sample group by date),
sd as (select u.permno, u.date, ret, bench, row_number() over (partition by u.permno order by u.date) as trade_idx from u left join mb using (date) where rn = 1),
w as ({_window_sql("sd", "permno", WINDOWS)}),
a as (select event_id, ev.permno, min(w.date) as date from ev join w on w.permno = ev.permno and w.date between event_date and event_date + 7 where ev.rn = 1 group by all)
select event_id, permno, strftime(date, '%Y-%m-%d') as anchor_date, """
    + ", ".join(f"round(raw_return_{n}, 5) as raw_return_{n}, round(benchmark_return_{n}, 5) as benchmark_return_{n}, round(raw_return_{n} - benchmark_return_{n}, 5) as abnormal_return_{n}, obs_count_{n}" for n in _SLUGS)
    + " from a join w using (permno, date)",
    "realized_labels": f"""with {_LAB} select event_id, expected, realized, magnitude, case when realized = 'unknown' then 'unobserved' when expected = realized then 'aligned'
  when expected = 'neutral' or realized = 'neutral' then 'mixed' else 'contrarian' end as alignment from lab""",
    "label_alignment": f"""with {_LAB} select expected as label, count(*) as events, round(avg(reaction), 6) as mean_return,
  round(avg(case expected when 'positive' then (reaction > 0)::int when 'negative' then (reaction < 0)::int end), 6) as hit_rate from lab where reaction is not null group by 1""",
    "long_short_spread": f"""with {_LAB}, m as (select avg(reaction) filter (expected = 'positive') as a, avg(reaction) filter (expected = 'negative') as b from lab)
select round(a, 6) as long_return, round(b, 6) as short_return, round(a - b, 6) as spread from m""",
}
