"""Every reader and writer on a round trip: a table is written in the format to the shared folder, read back and compared
with the table itself. Checks of deliveries, contracts and reports run on the tables as they lie."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.functions.clean import blank_to_null, scalar_text
from skarn.operators import profile as P
from skarn.plans.evaluation import LABELS, _runs
from skarn.session import cut, on_exit, shared_folder
from skarn.sources import checks, contracts, readers, sinks
from skarn.sources.tables import table as T


def _folder(spark: SparkSession) -> str:
    out = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    on_exit(spark, out)
    return out


def _text(spark: SparkSession, lines: DataFrame, ending: str) -> str:
    """Lines (column value) as text files in a folder with the given ending."""
    at = f"{_folder(spark)}/part{ending}"
    lines.write.text(at)
    return at


def contract_csv(spark, d):
    """A delivery with more columns, in another order, cut to its contract."""
    at = _folder(spark)
    sinks.write_csv(T(spark, d, "supplier").select("s_acctbal", "s_name", "s_suppkey", F.lit("x").alias("extra")), at)
    x = readers.read_contract_csv(spark, at, ["s_suppkey", "s_name"])
    return x.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


def malformed_csv(spark, d):
    """Rows with a field too many are kept and counted."""
    lines = T(spark, d, "orders").select(F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "surplus")).alias("value"))
    head = spark.createDataFrame([("o_orderkey,o_custkey",)], "value string")
    # one file: the header comes first
    at = _text(spark, head.unionByName(lines).coalesce(1), ".csv")
    x = cut(readers.read_counted_csv(spark, at))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("malformed"))


def csv_columns(spark, d):
    """A file's header, without a pass over it."""
    at = _folder(spark)
    sinks.write_csv(T(spark, d, "nation"), at)
    return spark.createDataFrame(list(enumerate(readers.csv_header(spark, at), 1)), "place int, name string")


def zip_member(spark, d):
    """An archive per region with nations in it, quoted line breaks and all."""
    folder = _folder(spark)

    def pack(key, pdf):
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        target, at = fs.FileSystem.from_uri(folder)
        target.create_dir(at, recursive=True)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "nations")
            z.writestr("in/nations.csv", pdf.sort_values("n_nationkey").to_csv(index=False))
        with target.open_output_stream(f"{at}/{key[0]}.zip") as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    x = T(spark, d, "nation").select("n_nationkey", "n_regionkey", F.concat("n_name", F.lit('\n"of", '), F.col("n_regionkey").cast("string")).alias("note"))
    x.groupBy("n_regionkey").applyInPandas(pack, "n long").collect()  # a row per region
    return readers.read_zip_csv(spark, f"{folder}/*.zip").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "note")


def numbered_jsonl(spark, d):
    """Lines with their numbers, blank ones counted; one that isn't JSON has no fields."""
    x = T(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 2, "broken").when(F.col("r_regionkey") == 3, "").otherwise(F.to_json(F.struct("r_regionkey", "r_name"))).alias("value"))
    at = _text(spark, x.coalesce(1).sortWithinPartitions("r_regionkey").select("value"), ".jsonl")
    return readers.read_numbered_jsonl(spark, at, "r_regionkey int, r_name string").select(F.col("_line_number").alias("line"), "r_regionkey", "r_name")


def jsonl_round_trip(spark, d):
    at = _folder(spark)
    x = T(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    n = sinks.write_jsonl(x, at)
    return readers.read_jsonl(spark, at, "c_custkey long, c_name string, c_mktsegment string").withColumn("written", F.lit(n))


def instruction_jsonl(spark, d):
    """Records whose required fields are checked and whose optional ones have defaults."""
    at = _folder(spark)
    sinks.write_jsonl(T(spark, d, "ibes_pipeline").where("instruction is not null").select("record_id", "instruction", "ticker"), at)
    x = readers.read_jsonl(spark, at, "record_id long, instruction string, ticker string", ["record_id", "instruction"], {"ticker": "UNK"})
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def eval_jsonl(spark, d):
    """Evaluation examples: the label is read from the output, an id from the record or made from it."""
    r = F.col("record_id")
    out = F.when(r % 3 == 0, F.concat(F.lit('{"direction": "'), F.coalesce(F.lower("direction_label"), F.lit("none")), F.lit('"}'))).otherwise(F.concat(F.lit("it is "), F.coalesce("direction_label", F.lit("unclear"))))
    x = T(spark, d, "ibes_pipeline").select(F.concat(F.lit("x"), r).alias("id"), "instruction", out.alias("output"))
    at = _folder(spark)
    sinks.write_jsonl(x, at)
    return readers.read_eval_examples(spark, at, "own").select("example_id", "target_label", "task_type", "input")


def sniffed_file(spark, d):
    """A delimited file whose delimiter nobody told."""
    x = T(spark, d, "supplier").select(F.concat_ws("|", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    at = _folder(spark) + "/s.csv"
    head = spark.createDataFrame([("key|name|nation",)], "value string")
    # one file: the header comes first
    head.unionByName(x).coalesce(1).write.text(at)
    return readers.read_any(spark, at).select(F.col("key").cast("long").alias("key"), "name", F.col("nation").cast("int").alias("nation"))


def first_source(spark, d):
    """The first place that can be read."""
    return readers.first_available(spark, [f"{d}/absent.csv", f"{d}/absent.parquet", f"{d}/region.parquet"]).select("r_regionkey", "r_name")


def exported_dataset(spark, d):
    at = _folder(spark)
    meta = sinks.export_dataset(T(spark, d, "ibes_pipeline"), at, {"instruction": "instruction", "input": "structured_input", "output": "direction_label"}, "own", "all")
    x = spark.read.schema("instruction string, input string, output string, source_dataset string, source_split string").json(f"{at}/records")
    return x.groupBy("output", "source_dataset", "source_split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("input")).alias("characters")).withColumn("exported", F.lit(meta["rows"]))


def settings_file(spark, d):
    text = spark.createDataFrame([("pipeline:\n  seed: 42\n  train_fraction: 0.9\n  windows:\n    - '0:1'\n    - '-1:1'\n  benchmark_column: vwretd  # index\n",)], "value string")
    x = readers.read_settings(spark, _text(spark, text.coalesce(1), ".yaml"))["pipeline"]
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in x.items()], "name string, value string")


def metrics_files(spark, d):
    tree = {"tasks": {"fpb": {"plain": {"base": {"accuracy": 0.5, "macro_f1": 0.25}, "tuned": {"accuracy": 0.75}}}, "own": {"plain": {"base": {"accuracy": 1, "other": 3}}}}}
    at = _text(spark, spark.createDataFrame([(json.dumps(tree),)], "value string").coalesce(1), ".json")
    return readers.read_metrics_json(spark, at, ["accuracy", "macro_f1"]).select("dataset", "mode", "variant", "metric", "value")


def filings(spark, d):
    """Filings of one form from parallel arrays, with accession numbers and addresses."""
    p, n = F.sequence(F.lit(1), (F.col("s_suppkey") % 4).cast("int")), F.col("s_suppkey").cast("string")
    some = lambda f: F.when(F.col("s_suppkey") % 4 > 0, F.transform(p, f)).otherwise(F.array().cast("array<string>"))
    recent = F.struct(
        some(lambda i: F.concat(F.lpad(n, 10, "0"), F.lit("-24-"), F.lpad(i.cast("string"), 6, "0"))).alias("accessionNumber"), some(lambda i: F.concat(F.lit("2024-01-0"), i.cast("string"))).alias("filingDate"), some(lambda i: F.lit("t")).alias("acceptanceDateTime"),
        some(lambda i: F.when(i % 2 == 1, "8-K").otherwise("10-K")).alias("form"), some(lambda i: F.concat(F.lit("d"), i.cast("string"), F.lit(".htm"))).alias("primaryDocument"), some(lambda i: F.lit("doc")).alias("primaryDocDescription"),
    )
    x = T(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("j"))
    return readers.filing_rows(x, "j", "8-K", key="s_suppkey").select("cik", "accession_number", F.col("filingDate").alias("filing_date"), "filing_url")


def parquet_sink(spark, d):
    at = _folder(spark)
    n = sinks.write_parquet(T(spark, d, "orders"), at)
    return spark.read.parquet(at).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("written", F.lit(n))


def json_report(spark, d):
    """A one-row report as a document, read back."""
    row = T(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"))
    return spark.createDataFrame([(k, int(v)) for k, v in json.loads(sinks.report_json(row)).items()], "name string, value long")


def markdown_report(spark, d):
    """A report of two tables, line by line."""
    n = T(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", "r_name")
    lines = sinks.report_sections("Tables", {"Note": "Two keys.", "Regions": n}).splitlines()
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line int, text string")


def confusion_table(spark, d):
    """Every pair of labels with its count, as the confusion file has them."""
    at = _folder(spark)
    sinks.write_csv(sinks.confusion_long(_runs(spark, d), ["dataset", "variant"], LABELS), at)
    return spark.read.option("header", True).schema("dataset string, variant string, place int, gold string, pred string, n long").csv(at)


def candidate_bundle(spark, d):
    """A candidate set on disk: its records without helper columns, and its card."""
    at = _folder(spark)
    x = T(spark, d, "ibes_pipeline").select("record_id", "direction_label", "structured_input", F.md5("structured_input").alias("sig"))
    n = sinks.write_bundle(x, P.dataset_card(x, ["direction_label"], F.col("sig"), "structured_input"), at, ("sig",))
    keys = spark.read.text(f"{at}/records").select(F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("keys")).groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    card = spark.read.option("header", True).csv(f"{at}/card").where("name = 'duplicate_rate'").select(F.col("value").cast("double").alias("duplicate_rate"))
    return keys.withColumns({"written": F.lit(n), "duplicate_rate": card.scalar()})


def stage_reuse(spark, d):
    """A stage is built once for a configuration and again when the configuration or an input file changes."""
    at, calls = _folder(spark), []
    build = lambda: (calls.append(1), T(spark, d, "nation"))[1]
    seen = []
    for conf, source in (("a", "nation"), ("a", "nation"), ("b", "nation"), ("b", "region")):
        sinks.materialise(spark, f"{at}/stage", conf, build, inputs=[f"{d}/{source}.parquet"])
        seen.append(len(calls))
    return spark.createDataFrame([(i, n) for i, n in enumerate(seen, 1)], "step int, builds int")


#: Contract -> accepted names and the table that should meet it.
CONTRACTS = {
    "events": (contracts.EVENT_ALIASES, "ibes_gold_events_sample"), "event identifiers": (contracts.EVENT_IDENTIFIERS, "ibes_gold_events_sample"), "daily": (contracts.DAILY_ALIASES, "crsp_daily_returns_sample"),
    "daily identifiers": (contracts.DAILY_IDENTIFIERS, "crsp_daily_returns_sample"), "link": (contracts.LINK_ALIASES, "crsp_compustat_link_sample"), "header": (contracts.HEADER_ALIASES, "crsp_compustat_link_sample"),
    "benchmark": (contracts.BENCHMARK_ALIASES, "market_benchmark_returns_sample"), "panel": (contracts.PANEL_ALIASES, "ibes_gold_events_sample"), "windows": (contracts.WINDOW_TABLE_ALIASES, "ibes_gold_events_sample"),
}


def contract_columns(spark, d):
    """What each contract finds in its table: canonical names with their columns, missing ones without."""
    out = []
    for name, (aliases, t) in CONTRACTS.items():
        found, missing = contracts.resolve_aliases(T(spark, d, t).columns, aliases)
        out += [(name, k, found.get(k)) for k in [*found, *missing]]
    return spark.createDataFrame(out, "contract string, name string, found string")


def _levels(spark: SparkSession, *found: tuple[str, checks.Findings, int]) -> DataFrame:
    rows = [(n, f.passed, sum(x == "fail" for x, _ in f.rows), sum(x == "warn" for x, _ in f.rows), k) for n, f, k in found]
    return spark.createDataFrame(rows, "check_name string, passed boolean, fails int, warnings int, planned int")


def delivery_checks(spark, d):
    """The four checks of a delivery, on the tables and on ones that lack what is needed."""
    p = {k: f"{d}/{t}.parquet" for k, t in (("events", "ibes_gold_events_sample"), ("daily", "crsp_daily_returns_sample"), ("link", "crsp_compustat_link_sample"), ("benchmark", "market_benchmark_returns_sample"))}
    panel, steps = checks.check_event_panel(spark, p["events"], p["daily"], p["link"], benchmark=p["benchmark"])
    unlinked, none = checks.check_event_panel(spark, p["events"], p["daily"])
    windows, columns = checks.check_event_windows(spark, p["events"], p["daily"], ["0:1", "-1:1"], p["benchmark"])
    folder = _folder(spark)
    ev = T(spark, d, "ibes_gold_events_sample").limit(1)
    made = ev.withColumns({"permno": F.lit(1), "join_key_type": F.lit("gvkey"), "join_status": F.lit("matched"), **{c: F.lit(0.0) for c in contracts.window_columns(["0:1"])}})
    made.write.parquet(f"{folder}/panel.parquet")
    ready, planned = checks.check_event_windows(spark, f"{folder}/panel.parquet", p["daily"], ["0:1", "-1:1"], p["benchmark"])
    alignment, metrics = checks.check_label_alignment(spark, f"{folder}/panel.parquet", ["label_direction", "other"], ["0:1"])
    return _levels(
        spark, ("market data", checks.check_market_data(spark, p["daily"], p["link"], p["benchmark"]), 0), ("market data without links", checks.check_market_data(spark, p["daily"]), 0), ("panel", panel, len(steps)),
        ("panel without links", unlinked, len(none)), ("windows of events", windows, len(columns)), ("windows of a panel", ready, len(planned)), ("alignment", alignment, len(metrics)),
    )


def scalar_values(spark, d):
    """Values made ready for JSON, and text trimmed to upper case."""
    x = T(spark, d, "crsp_daily_returns_sample")
    e = x.select("permno", scalar_text(F.col("date"), "date").alias("day"), scalar_text(F.when(F.col("permno") % 2 == 0, F.col("ret")).otherwise(F.lit(float("nan"))), "double").alias("ret"), F.abs("prc").alias("price"))
    return e.distinct()


def upper_tickers(spark, d):
    return T(spark, d, "ibes_gold_events_sample").groupBy(F.upper(blank_to_null(F.col("ticker"))).alias("ticker_norm")).agg(F.count(F.lit(1)).alias("n"))


def public_signatures(spark, d):
    """Distinct signatures of instruction, input and label, per source."""
    x = T(spark, d, "ibes_pipeline").withColumn("sig", X.signature(F.col("instruction"), F.col("structured_input"), F.col("direction_label")))
    return x.groupBy("source").agg(F.count_distinct("sig").alias("signatures"), F.count(F.lit(1)).alias("n"))


def mixed_heads(spark, d):
    """A mix of a head of one source and a sample of others: the first 80 of a hundred rows by hash, then 20 of the rest."""
    from skarn.operators.splitting import hash_sample

    x = T(spark, d, "ibes_pipeline").select("record_id", "split")
    a = hash_sample(x.where("split = 'train'"), "record_id", 80, 3).withColumn("part", F.lit("own"))
    return a.unionByName(hash_sample(x.where("split <> 'train'"), "record_id", 20, 3).withColumn("part", F.lit("other"))).select("record_id", "part")


def file_sizes(spark, d):
    return spark.createDataFrame([(n, sinks.human_size(n)) for n in (0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4, 2**60)], "bytes long, size string")


QUERIES = {f.__name__: f for f in (
    contract_csv, malformed_csv, csv_columns, zip_member, numbered_jsonl, jsonl_round_trip, instruction_jsonl, eval_jsonl, sniffed_file, first_source, exported_dataset, settings_file, metrics_files, filings, parquet_sink, json_report, markdown_report, confusion_table,
    candidate_bundle, stage_reuse, contract_columns, delivery_checks, scalar_values, upper_tickers, public_signatures, mixed_heads, file_sizes,
)}


def _contracts_sql() -> str:
    """The names a contract accepts, as a table, met with the columns of its table."""
    names = ", ".join(f"('{c}', '{t}', '{k}', '{n}', {i})" for c, (aliases, t) in CONTRACTS.items() for k, ns in aliases.items() for i, n in enumerate(ns))
    cols = " union all ".join(f"select '{t}' as t, unnest(json_keys(to_json(x))) as c from (select * from {t} limit 1) x" for t in sorted({t for _, t in CONTRACTS.values()}))
    return f"""with n(contract, t, name, accepted, place) as (values {names}), c as ({cols}),
m as (select n.contract, n.name, c.c as col, row_number() over (partition by n.contract, n.name order by c.c is null, place) as rn from n left join c on c.t = n.t and lower(c.c) = n.accepted)
select contract, name, col as found from m where rn = 1"""


_SIG3 = "sha1(concat_ws(chr(31), " + ", ".join(f"coalesce(trim(regexp_replace(lower({c}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')" for c in ("instruction", "structured_input", "direction_label")) + "))"
_WORD = "case when contains(lower(o), 'positive') then 'positive' when contains(lower(o), 'negative') then 'negative' when contains(lower(o), 'neutral') then 'neutral' when regexp_matches(lower(o), '\\byes\\b') then 'yes' when regexp_matches(lower(o), '\\bno\\b') then 'no' end"

SQL = {
    "contract_csv": "select s_suppkey, s_name from supplier",
    "malformed_csv": "select count(*) as rows, count(*) filter (o_orderkey % 10 = 0) as malformed from orders",
    "csv_columns": "select * from (values (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) v(place, name)",
    "zip_member": """select n_nationkey, n_name || chr(10) || '"of", ' || n_regionkey as note from nation""",
    "numbered_jsonl": "select row_number() over (order by r_regionkey) as line, case when r_regionkey <> 2 then r_regionkey end as r_regionkey, case when r_regionkey <> 2 then r_name end as r_name from region qualify r_regionkey is distinct from 3 or r_name is null",
    "jsonl_round_trip": "select c_custkey, case when c_custkey % 5 > 0 then c_name end as c_name, c_mktsegment, (select count(*) from customer) as written from customer",
    "instruction_jsonl": "select coalesce(ticker, 'UNK') as ticker, count(*) as n from ibes_pipeline where instruction is not null group by 1",
    "eval_jsonl": f"""with x as (select record_id, record_id % 3 = 0 as s, case when record_id % 3 = 0 then coalesce(lower(direction_label), 'none') else 'it is ' || coalesce(direction_label, 'unclear') end as o from ibes_pipeline)
select 'x' || record_id as example_id, case when s then o else {_WORD} end as target_label, case when s then 'structured' else 'classification' end as task_type, '' as input from x""",
    "sniffed_file": "select s_suppkey as key, s_name as name, s_nationkey as nation from supplier",
    "first_source": "select r_regionkey, r_name from region",
    "exported_dataset": """with x as (select coalesce(instruction, '') as i, coalesce(structured_input, '') as s, coalesce(direction_label, '') as o from ibes_pipeline), y as (select * from x where trim(i) <> '' or trim(o) <> '')
select o as output, 'own' as source_dataset, 'all' as source_split, count(*) as n, sum(length(s))::bigint as characters, (select count(*) from y) as exported from y group by o""",
    "settings_file": """select * from (values ('seed', '42'), ('train_fraction', '0.9'), ('windows', '["0:1", "-1:1"]'), ('benchmark_column', '"vwretd"')) v(name, value)""",
    "metrics_files": "select dataset, mode, variant, metric, value::double as value from (values ('fpb', 'plain', 'base', 'accuracy', 0.5), ('fpb', 'plain', 'base', 'macro_f1', 0.25), ('fpb', 'plain', 'tuned', 'accuracy', 0.75), ('own', 'plain', 'base', 'accuracy', 1)) v(dataset, mode, variant, metric, value)",
    "filings": """with x as (select s_suppkey, unnest(range(1, s_suppkey % 4 + 1)) as i from supplier)
select lpad(s_suppkey::varchar, 10, '0') as cik, lpad(s_suppkey::varchar, 10, '0') || '24' || lpad(i::varchar, 6, '0') as accession_number, '2024-01-0' || i as filing_date,
  'https://www.sec.gov/Archives/edgar/data/' || s_suppkey || '/' || lpad(s_suppkey::varchar, 10, '0') || '24' || lpad(i::varchar, 6, '0') || '/d' || i || '.htm' as filing_url from x where i % 2 = 1""",
    "parquet_sink": "select o_orderpriority, count(*) as n, (select count(*) from orders) as written from orders group by 1",
    "json_report": "select 'rows' as name, count(*) as value from orders union all select 'customers', count(distinct o_custkey) from orders",
    "markdown_report": """with l as (select unnest(['# Tables', '', '## Note', '', 'Two keys.', '', '## Regions', '', '| r_regionkey | r_name |', '| --- | --- |']) as text, unnest(range(1, 11)) as line)
select line::int as line, text from l union all select (10 + row_number() over (order by r_regionkey))::int, '| ' || r_regionkey || ' | ' || r_name || ' |' from region""",
    "candidate_bundle": """select 'direction_label,record_id,structured_input' as keys, count(*) as n, count(*) as written, round((count(*) - count(distinct coalesce(structured_input, '')) ) / count(*), 4) as duplicate_rate from ibes_pipeline""",
    "stage_reuse": "select * from (values (1, 1), (2, 1), (3, 2), (4, 3)) v(step, builds)",
    "delivery_checks": """select * from (values ('market data', true, 0, 2, 0), ('market data without links', false, 1, 3, 0), ('panel', true, 0, 0, 1), ('panel without links', false, 1, 0, 0),
  ('windows of events', false, 1, 0, 0), ('windows of a panel', true, 0, 0, 6), ('alignment', true, 0, 1, 1)) v(check_name, passed, fails, warnings, planned)""",
    "scalar_values": "select distinct permno, strftime(date, '%Y-%m-%d') as day, case when permno % 2 = 0 then round(ret, 6) end as ret, abs(prc) as price from crsp_daily_returns_sample",
    "upper_tickers": "select upper(nullif(trim(ticker), '')) as ticker_norm, count(*) as n from ibes_gold_events_sample group by 1",
    "public_signatures": f"select source, count(distinct {_SIG3}) as signatures, count(*) as n from ibes_pipeline group by source",
    "mixed_heads": "(select record_id, 'own' as part from ibes_pipeline where split = 'train' order by md5(record_id || '#3'), record_id limit 80) union all (select record_id, 'other' from ibes_pipeline where split <> 'train' order by md5(record_id || '#3'), record_id limit 20)",
    "file_sizes": "select * from (values (0, '0 B'), (1023, '1023 B'), (1024, '1.0 KB'), (1536, '1.5 KB'), (5242880, '5.0 MB'), (3298534883328, '3.0 TB'), (1152921504606846976, '1048576.0 TB')) v(bytes, size)",
}


def _confusion_sql() -> str:
    from skarn.plans.evaluation import _RUNS

    return f"""with {_RUNS}, g2 as (select a.l as gold, b.l as pred, (a.p * 4 + b.p)::int as place from (values ('negative', 0), ('neutral', 1), ('positive', 2)) a(l, p), (values ('negative', 0), ('neutral', 1), ('positive', 2), ('__invalid__', 3)) b(l, p)),
k as (select distinct dataset, variant from runs), n as (select dataset, variant, gold, coalesce(pred, '__invalid__') as pred, count(*) as n from runs group by all)
select k.dataset, k.variant, place, g2.gold, g2.pred, coalesce(n, 0) as n from k, g2 left join n on n.dataset = k.dataset and n.variant = k.variant and n.gold = g2.gold and n.pred = g2.pred"""


SQL |= {"confusion_table": _confusion_sql(), "contract_columns": _contracts_sql()}
