"""Queries p7 and p8 over the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.keys import folded
from skarn.llm.leaks import leaked_passages
from skarn.llm.mixing import BLOCKS, SHARD_TOKENS, count_tokens, mix_sources
from skarn.sources.tables import table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Only passages that stand in the document word for word."""
    return _leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that hold a passage of it word for word."""
    hits = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, d, "heldout_items").select("item_id", "benchmark", "item_split")
    return items.join(hits, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an item with one edit, and none word for word."""
    return _leaks(spark, d).where("edits > 0")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = count_tokens(table(spark, d, "documents"), "doc_id", folded(F.col("source")), "text")
    targets = table(spark, d, "mix_targets").select(folded(F.col("source")).alias("source"), "target_share", "max_repeats")
    return mix_sources(counted, targets, seed=8)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    short = _mix(spark, d)[1].where("short").select(F.col("source").alias("x"))
    t = table(spark, d, "mix_targets")
    return t.join(short, folded(t["source"]) == F.col("x"), "left_semi").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _mix_characters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same mix with sizes in characters, which SQL can count too."""
    docs = table(spark, d, "documents")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").alias("id"), folded(F.col("source")).alias("source"), size.alias("tokens"), F.md5("text").alias("copy"))
    targets = table(spark, d, "mix_targets").select(folded(F.col("source")).alias("source"), "target_share", "max_repeats")
    return mix_sources(counted, targets, seed=8)


def p8_mix_characters(spark: SparkSession, d: str) -> DataFrame:
    return _mix_characters(spark, d)[0].withColumnsRenamed({"id": "doc_id", "tokens": "characters"})


def p8_report_characters(spark: SparkSession, d: str) -> DataFrame:
    return _mix_characters(spark, d)[1].withColumnsRenamed({"tokens": "characters", "reached_tokens": "reached_characters"})


QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_near": p7_near, "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report, "p8_mix_characters": p8_mix_characters, "p8_report_characters": p8_report_characters}

_WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', '', 'g'), '[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}\x{ad}\x{180e}]', '', 'g')), '[\p{L}\p{N}]+')"

_FOUND = f"""d as (select doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w from heldout_items where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k + 9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d where len(w) >= 10)),
ig as (select distinct item_id, array_to_string(w[k:k + 9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i where len(w) >= 10)),
f as (select distinct doc_id, item_id from dg join ig using (g))"""

_H = lambda seed: f"(('0x' || substr(md5(cast(id as varchar) || '#{seed}'), 1, 15))::bigint)"
_MIX = f"""d as materialized (select doc_id as id, nullif(lower(trim(source)), '') as source, coalesce(length(text), 0)::bigint as n, md5(text) as c from documents),
k as (select sum(n)::bigint as total, greatest(1, sum(n)::bigint // {BLOCKS}) as size, greatest(1, -(-sum(n)::bigint // {SHARD_TOKENS})) as shards from d),
t as (select nullif(lower(trim(source)), '') as source, max(coalesce(target_share, 0)) as share, max(coalesce(max_repeats, 0)) as most from mix_targets where trim(source) <> '' group by 1),
u as materialized (select x.id as id, x.source as source, x.n as n from (select min(struct_pack(id := id, source := source, n := n)) as x from d where n > 0 and source in (select source from t) group by c)),
r as materialized (select t.*, coalesce(x, 0) as usable, coalesce(x, 0) * most as room from t left join (select source, sum(n)::bigint as x from u group by 1) using (source)),
o as materialized (select source, row_number() over (order by (b - 0.5) / share, source) as place from (select source, share, unnest(range(1, (room + (select size from k) - 1) // (select size from k) + 1)) as b from r where share > 0)),
-- tokens that part-full last blocks lack are handed out again as whole blocks
v as (select row_number() over (partition by source order by place) as b, source, place from o),
e as materialized (select place, v.source, greatest(0, b * (select size from k) - room) - greatest(0, (b - 1) * (select size from k) - room) as lack from v join r using (source)),
g as materialized (select place, sum(lack) over (order by place)::bigint as lack from e),
y as (with recursive z(i, n) as (select 0, (select total // size from k) union all select i + 1, (select total // size from k) + coalesce((select max(lack) from g where place <= z.n), 0) // (select size from k) from z where i < (select count(*) from t)) select n from z order by i desc limit 1),
q as materialized (select r.*, coalesce(b, 0) as blocks, least(coalesce(b, 0) * (select size from k), room) as quota from r left join (select source, count(*) as b from o where place <= (select n from y) group by 1) using (source)),
l as (select u.*, sum(n) over (partition by source order by {_H(8)} % (select shards from k), {_H(9)}, id) - n as start from u),
s as materialized (select id, source, n, least(most, greatest(0, (quota - start + usable - 1) // usable))::int as repeats from l join q using (source) where least(most, greatest(0, (quota - start + usable - 1) // usable)) > 0)"""

SQL = {
    "p7_found": f"with {_FOUND} select * from f",
    "p7_report": f"with {_FOUND} select item_id, benchmark, item_split, (select count(*) from f where f.item_id = h.item_id) as documents from heldout_items h",
    "p8_mix_characters": f"with {_MIX} select id as doc_id, source, n as characters, repeats from s",
    "p8_report_characters": f"""with {_MIX}, w as (select source, sum(n * repeats)::bigint as got from s group by 1), a as (select source, sum(n)::bigint as n from d group by 1)
select q.source, share as target_share, most as max_repeats, blocks, quota, coalesce(n, 0) as characters, coalesce(got, 0) as reached_characters, share * (select total from k) as wanted,
  coalesce(got, 0) / (select sum(got) from w) as reached_share, coalesce(n, 0) * most < share * (select total from k) as short from q left join a using (source) left join w using (source)""",
    # words and signs stand for tokens: every public tokenizer gives the same rows
    "p8_found": """with d as (select lower(trim(source)) as source, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) as n from documents where text is not null),
s as (select source, sum(n) as n from d group by source)
select t.source from mix_targets t left join s on s.source = lower(trim(t.source)) where coalesce(n, 0) * max_repeats < target_share * (select sum(n) from d)""",
}
