"""Queries p5 and p6 over the security link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.keys import numeric_key, six_digits
from skarn.operators.bitemporal import as_known
from skarn.operators.intervals import periods_and_gaps
from skarn.sources.tables import table

OPEN_END = "9999-12-31"


def usable_links(spark: SparkSession, d: str) -> DataFrame:
    """Link rows with a permno and a start that isn't after the end; an open end is the last day of the calendar."""
    end = F.coalesce("linkenddt", F.to_date(F.lit(OPEN_END)))
    return table(spark, d, "crsp_compustat_link_sample").withColumn("linkenddt", end).where("permno is not null and linkdt is not null and gvkey is not null and linkdt <= linkenddt")


def events_with_permno(events: DataFrame, links: DataFrame) -> DataFrame:
    """One row per event_id that resolves: event_id, event_date, permno, linkdt.

    A link is known from the day it starts, so an event sees the links that cover its day and started by then; the
    latest start wins, then the smallest permno. Rows delivered twice, or with differing figures, are one event.
    """
    ev = events.select("event_id", "gvkey", "event_date").where("event_id is not null and gvkey is not null and event_date is not null")
    d = F.col("event_date")
    known = as_known(
        ev, links,
        event_key=numeric_key(F.col("gvkey")), event_day=d, known_day=d,
        version_key=numeric_key(F.col("gvkey")), valid_from=F.col("linkdt"), valid_to=F.col("linkenddt"), recorded_from=F.col("linkdt"),
        rank=[F.unix_date("linkdt"), -F.col("permno")], payload=["permno", "linkdt"],
    ).where("known is not null")
    best = F.max(F.struct(F.col("known.linkdt").alias("linkdt"), (-F.col("known.permno")).alias("np"), d.alias("event_date"))).alias("b")
    return known.groupBy("event_id").agg(best).select("event_id", "b.event_date", (-F.col("b.np")).cast("int").alias("permno"), "b.linkdt")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return events_with_permno(table(spark, d, "ibes_gold_events_sample"), usable_links(spark, d)).select("event_id", "permno")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = periods_and_gaps(usable_links(spark, d), numeric_key(F.col("gvkey")), F.col("linkdt"), F.col("linkenddt"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select(six_digits(F.col("key")).alias("gvkey"), "kind", day("first_day"), day("last_day"))


QUERIES = {"p5_found": p5_found, "p6_found": p6_found}

_LINKS = """select ltrim(trim(gvkey), '0') as k, permno, linkdt, coalesce(linkenddt, date '9999-12-31') as e
  from crsp_compustat_link_sample where permno is not null and linkdt is not null and gvkey is not null
   and linkdt <= coalesce(linkenddt, date '9999-12-31')"""

SQL = {
    "p5_found": f"""with l as ({_LINKS})
select event_id, permno from (
  select event_id, permno, row_number() over (partition by event_id order by linkdt desc, permno) as rn
  from ibes_gold_events_sample g join l on ltrim(trim(g.gvkey), '0') = l.k and g.event_date between l.linkdt and l.e
  where event_id is not null) where rn = 1""",
    "p6_found": f"""with u as ({_LINKS}), l as (select distinct k, linkdt, e from u),
m as (select k, linkdt as s, e, max(e) over (partition by k order by linkdt, e rows between unbounded preceding and 1 preceding) as pe from l),
g as (select k, s, e, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as grp from m),
p as (select k, grp, min(s) as f, max(e) as t from g group by k, grp),
n as (select k, f, t, lead(f) over (partition by k order by f) as nf from p)
select lpad(k, 6, '0') as gvkey, 'period' as kind, strftime(f, '%Y-%m-%d') as first_day, strftime(t, '%Y-%m-%d') as last_day from n
union all
select lpad(k, 6, '0'), 'gap', strftime(t + 1, '%Y-%m-%d'), strftime(nf - 1, '%Y-%m-%d') from n where nf is not null""",
}
