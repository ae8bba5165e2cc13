"""Queries p1 to p3 over analyst events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.keys import folded, numeric_key, stripped, ticker_root
from skarn.llm.nearest import nearest_in_time
from skarn.llm.sampling import proportional_sample
from skarn.llm.splits import BINS, split_entities
from skarn.plans.links import events_with_permno, usable_links
from skarn.session import cut
from skarn.sources.tables import table

EVENTS = "ibes_gold_events_sample"
#: Days between an event and its trade.
TRADE_TOLERANCE = 5


def _splits(spark: SparkSession, d: str, tie_repeats: bool = True) -> tuple[DataFrame, DataFrame]:
    keys = [ticker_root(F.col("ticker")), numeric_key(F.col("gvkey"))]
    return split_entities(table(spark, d, EVENTS), "event_id", keys, table(spark, d, "split_targets"), tie_repeats)


def _ticker_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker string with the component and split the splits give its root; an event's id ties nothing here."""
    nodes = _splits(spark, d, False)[1]
    root = ticker_root(F.col("ticker"))
    tickers = table(spark, d, EVENTS).select("ticker", F.concat(F.lit("0:"), root).alias("node")).where("node is not null").distinct()
    return cut(tickers.join(nodes, "node").select("ticker", "component", "split"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ticker strings of one entity, hence of one split; the pairs are what is asked for, so they are written out."""
    of = _ticker_entities(spark, d)
    a, b = (of.withColumnRenamed("ticker", f"ticker_{x}") for x in "ab")
    return a.join(b, ["component", "split"]).where("ticker_a < ticker_b").select("ticker_a", "ticker_b")


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per ticker string: its entity, named by its least ticker, and the number of the entity's other tickers."""
    of = _ticker_entities(spark, d)
    per = of.groupBy("component").agg(F.min("ticker").alias("entity"), (F.count(F.lit(1)) - 1).alias("links"))
    return of.join(per, "component").select("ticker", "entity", "links")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)[0].withColumnRenamed("id", "event_id")


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per split: whether its share lies within a bin of its target, or of what the heaviest entity leaves; and its events' entities that lie elsewhere too."""
    x = cut(p1_splits(spark, d))
    per = x.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total, most = x.agg(F.count(F.lit(1)).alias("n")).scalar(), x.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    slack = F.lit(1 / BINS) * 2 + F.greatest(F.lit(0.0), most / total - F.lit(1 / BINS))
    torn = x.groupBy("component").agg(F.count_distinct("split").alias("s"), F.min("split").alias("split")).where("s > 1").groupBy("split").agg(F.count(F.lit(1)).alias("torn"))
    t = table(spark, d, "split_targets")
    near = F.abs(F.coalesce("n", F.lit(0)) / total - F.col("target_share")) <= slack
    return t.join(per, "split", "left").join(torn, "split", "left").select("split", near.alias("near_target"), F.coalesce("torn", F.lit(0)).alias("torn_entities"))


def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, EVENTS).groupBy("event_id").agg(F.min("event_date").alias("event_date"))
    per = (
        p1_splits(spark, d).join(day, "event_id")
        .groupBy("split", "component").agg(F.count(F.lit(1)).alias("events"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
        .groupBy("split").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("entities"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    )
    total = per.agg(F.sum("events")).scalar()
    targets = table(spark, d, "split_targets")
    return targets.join(per, "split", "left").select("split", "target_share", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("entities", F.lit(0)).alias("entities"), (F.coalesce("events", F.lit(0)) / total).alias("share"), "first_day", "last_day")


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "sample_targets")
    size = t.agg(F.max("sample_rows"), F.max("max_per_ticker")).first()  # one row of settings
    label = lambda a, b: F.concat_ws("\t", F.nullif(folded(a), F.lit("")), folded(b))
    pair = lambda a, b: F.when(folded(a).isNotNull() & folded(b).isNotNull(), label(a, b))
    targets = t.select(pair(F.col("label_direction"), F.col("label_magnitude")).alias("category"), "target_share", "min_rows", F.col("max_per_ticker").alias("max_per_group"))
    ev = table(spark, d, EVENTS)
    return proportional_sample(
        ev, "event_id", pair(F.col("label_direction"), F.col("label_magnitude")), targets, group=ticker_root(F.col("ticker")), max_per_group=size[1], n=size[0] or 0, seed=20
    )


def _labels(df: DataFrame) -> DataFrame:
    two = F.split("category", "\t")
    return df.withColumns({"label_direction": two[0], "label_magnitude": two[1]}).drop("category")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    short = _labels(_sample(spark, d)[1].where("short")).select(F.col("label_direction").alias("x"), F.col("label_magnitude").alias("y"))
    t = table(spark, d, "sample_targets")
    return t.join(short, (folded(t["label_direction"]) == F.col("x")) & (folded(t["label_magnitude"]) == F.col("y")), "left_semi").select("label_direction", "label_magnitude")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _labels(_sample(spark, d)[0]).select("event_id", "label_direction", "label_magnitude", F.col("g").alias("ticker_root"), "rank")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _labels(_sample(spark, d)[1]).select("label_direction", "label_magnitude", "target_share", "min_rows", "available", "wanted", "seats", "reached", "short")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ev = events_with_permno(table(spark, d, EVENTS), usable_links(spark, d))
    daily = table(spark, d, "crsp_daily_returns_sample")
    hit = nearest_in_time(ev, daily, left_key=F.col("permno"), left_time=F.unix_date("event_date"), right_key=F.col("permno"), right_time=F.unix_date("date"), tolerance=TRADE_TOLERANCE)
    return hit.select("event_id", "permno", F.date_format(F.date_from_unix_date(F.col("nearest_time").cast("int")), "yyyy-MM-dd").alias("trade_date"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p1_splits": p1_splits, "p1_balance": p1_balance, "p1_split_report": p1_split_report, "p2_found": p2_found, "p2_sample": p2_sample, "p2_report": p2_report, "p3_found": p3_found}

_ROOT = r"regexp_replace(upper(trim(ticker)), '\.[A-Z]{1,2}$', '')"
_CLASSES = f"""e as (
  select event_id, min(struct_pack(c := lower(trim(label_direction)) || chr(9) || lower(trim(label_magnitude)), g := {_ROOT})) as x
  from ibes_gold_events_sample where ticker is not null and label_direction is not null and label_magnitude is not null group by event_id),
a as (select c, sum(least(n, k))::bigint as available from (
  select x.c as c, x.g as g, count(*) as n, (select max(max_per_ticker) from sample_targets) as k from e group by 1, 2) group by c)"""

_ENTITIES = f"""recursive t as (select distinct ticker, {_ROOT} as r, ltrim(trim(gvkey), '0') as g from ibes_gold_events_sample where trim(ticker) <> ''),
n as (select distinct a.r as a, b.r as b from t a join t b on a.g = b.g),
c(a, b) as (select distinct r, r from t union select c.a, n.b from c join n on c.b = n.a),
s as (select distinct ticker, r from t)"""
_SEATS = """t as (select lower(trim(label_direction)) as d, lower(trim(label_magnitude)) as m, max(target_share) as s, max(min_rows) as f, max(sample_rows) as n from sample_targets group by 1, 2),
c as (select t.*, coalesce(available, 0) as available from t left join a on a.c = d || chr(9) || m),
r as (select d, m, k, (case when k <= f then 0 else 1 end) as late, (k - 0.5) / nullif(s, 0) as p, n from (select *, unnest(range(1, available + 1)) as k from c)),
o as (select d, m, row_number() over (order by late, p, d || chr(9) || m) as place, n from r where late = 0 or p is not null),
q as (select d, m, count(*) as seats from o where place <= n group by 1, 2)"""

SQL = {
    "p1_found": f"with {_ENTITIES} select distinct x.ticker as ticker_a, y.ticker as ticker_b from s x join c on x.r = c.a join s y on y.r = c.b where x.ticker < y.ticker",
    "p1_entities": f"with {_ENTITIES} select x.ticker, min(y.ticker) as entity, count(distinct y.ticker) - 1 as links from s x join c on x.r = c.a join s y on y.r = c.b group by x.ticker",
    "p1_balance": "select split, true as near_target, 0 as torn_entities from split_targets",
    "p2_found": f"""with {_CLASSES}
select label_direction, label_magnitude from sample_targets t left join a on a.c = lower(trim(label_direction)) || chr(9) || lower(trim(label_magnitude))
where coalesce(available, 0) < greatest(min_rows, target_share * sample_rows)""",
    "p3_found": """with l as (select ltrim(trim(gvkey), '0') as k, permno, linkdt, coalesce(linkenddt, date '9999-12-31') as e
  from crsp_compustat_link_sample where permno is not null and linkdt is not null and gvkey is not null and linkdt <= coalesce(linkenddt, date '9999-12-31')),
p as (select event_id, event_date, permno, row_number() over (partition by event_id order by linkdt desc, permno) as rn
  from ibes_gold_events_sample g join l on ltrim(trim(g.gvkey), '0') = l.k and g.event_date between l.linkdt and l.e where event_id is not null)
select event_id, permno, strftime(date, '%Y-%m-%d') as trade_date from (
  select p.event_id, p.permno, d.date, row_number() over (partition by p.event_id order by abs(d.date - p.event_date), d.date desc) as k
  from p join crsp_daily_returns_sample d on d.permno = p.permno and abs(d.date - p.event_date) <= 5 where p.rn = 1) where k = 1""",
    "p2_report": f"""with {_CLASSES}, {_SEATS}
select d as label_direction, m as label_magnitude, s as target_share, f as min_rows, available, greatest(f, s * n) as wanted, coalesce(seats, 0) as seats, coalesce(seats, 0) / (select sum(seats) from q) as reached,
  available < greatest(f, s * n) as short from c left join q using (d, m)""",
    "p2_sample": f"""with {_CLASSES}, {_SEATS},
h as (select event_id, x.c as c, x.g as g, md5(event_id || '#20') as h from e),
w as (select * from h qualify row_number() over (partition by c, g order by h, event_id) <= (select max(max_per_ticker) from sample_targets)),
z as (select *, row_number() over (partition by c order by h, event_id) as rank from w)
select event_id, d as label_direction, m as label_magnitude, g as ticker_root, rank from z join q on z.c = q.d || chr(9) || q.m where rank <= seats""",
}
