"""Readers for text extracts. Everything stays distributed; only headers and samples come to the driver."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skarn.functions.text import json_blob, label_in_text
from skarn.session import on_exit, shared_folder
from skarn.sources.contracts import ContractError, require_columns

FORMATS = {".csv": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".zip": "zip", ".parquet": "parquet"}


def read_contract_csv(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """CSV with a header, all text, cut to ``columns``; a missing column or a malformed row is an error."""
    return require_columns(spark.read.option("header", True).option("mode", "FAILFAST").csv(path), columns)


def read_counted_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text, and ``_corrupt_record``: malformed rows are kept and can be counted, not dropped."""
    names = csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record"]])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Iterable[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped. Absent optional fields get their default.

    ``required`` fields must not be null in any row; the check is one aggregation. A file without rows is an error if
    fields are required.
    """
    df = spark.read.schema(schema).json(path)
    required = list(required)
    if required:
        bad = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        if not bad["n"]:
            raise ContractError(f"no records in {path}")
        if gone := [c for c in required if bad[c]]:
            raise ContractError(f"records without {', '.join(gone)} in {path}")
    return df.fillna(defaults) if defaults else df


def read_eval_examples(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """example_id, dataset, instruction, input, output, target_label, task_type from evaluation JSON lines.

    The id is event_id, else id, else the dataset's name and a digest of the record. The label is the output's
    direction_label or direction if the output is a JSON object, else the label word in it.
    """
    df = spark.read.schema("event_id string, id string, instruction string, input string, output string").json(path).where("instruction is not null or output is not null")
    blob = F.when(F.ltrim("output").startswith("{"), json_blob(F.col("output")))
    fallback = F.concat(F.lit(f"{dataset}-"), F.substring(F.sha1(F.to_json(F.struct("instruction", "input", "output"))), 1, 12))
    label = F.when(blob.isNotNull(), F.coalesce(F.get_json_object(blob, "$.direction_label"), F.get_json_object(blob, "$.direction"))).otherwise(label_in_text(F.col("output")))
    return df.select(
        F.coalesce("event_id", "id", fallback).alias("example_id"), F.lit(dataset).alias("dataset"), "instruction", F.coalesce("input", F.lit("")).alias("input"), "output",
        label.alias("target_label"), F.when(blob.isNotNull(), "structured").otherwise("classification").alias("task_type"),
    )


def detect_format(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ContractError(f"no reader for {path}; known endings: {', '.join(sorted(FORMATS))}")
    return FORMATS[suffix]


def sniff_delimiter(sample: str, fallback: str = ",") -> str:
    """Comma, tab or bar, from the first 8,192 characters."""
    try:
        return csv.Sniffer().sniff(sample[:8192], delimiters=",\t|").delimiter
    except csv.Error:
        return fallback


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file ending; the delimiter of .csv files is found from the first lines."""
    kind = detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "zip":
        return read_zip_csv(spark, path)
    sep = "\t" if kind == "tsv" else sniff_delimiter("\n".join(r[0] for r in spark.read.text(path).limit(40).collect()))
    return spark.read.option("header", True).option("sep", sep).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def inspect(spark: SparkSession, path: str, samples: int = 3) -> dict[str, object]:
    """format, delimiter (of delimited text), columns and the first ``samples`` rows of a file, without a pass over it."""
    kind = detect_format(path)
    sep = None
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else sniff_delimiter("\n".join(r[0] for r in spark.read.text(path).limit(40).collect()))
    df = read_any(spark, path)
    return {"format": kind, "delimiter": sep, "columns": df.columns, "samples": [r.asDict() for r in df.limit(samples).collect()]}


def _member(names: list[str], wanted: str | None) -> str:
    files = [n for n in names if not n.endswith("/")]
    if wanted in files:
        return wanted
    if wanted or not files:
        raise ContractError(f"no member {wanted or ''} in the archive")
    return next((n for n in files if PurePosixPath(n).suffix.lower() in (".csv", ".tsv", ".jsonl", ".ndjson")), files[0])


#: Bytes of text in a part that an archive member is unpacked to.
PART_BYTES = 64_000_000


def _unpack(folder: str, member: str | None, part_bytes: int):
    """Archive paths to (part, kind, header): members unpacked to files of whole records under ``folder``, each with the header."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for path in b["path"]:
                source, at = fs.FileSystem.from_uri(path)
                target, to = fs.FileSystem.from_uri(folder)
                target.create_dir(to, recursive=True)
                name = uuid.uuid5(uuid.NAMESPACE_URL, path).hex  # a task that runs again writes the same files
                with source.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                    wanted = _member(z.namelist(), member)
                    lines_of_json = PurePosixPath(wanted).suffix.lower() in (".jsonl", ".ndjson")
                    with z.open(wanted) as f:
                        header = b"" if lines_of_json else next(f, b"").removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n") + b"\n"
                        number, size, out, open_quote = 0, 0, None, False
                        for line in f:
                            if out is None:
                                out = target.open_output_stream(f"{to}/{name}-{number:06}")
                                out.write(header)
                            out.write(line if line.endswith(b"\n") else line + b"\n")
                            size += len(line)
                            open_quote ^= not lines_of_json and line.count(b'"') % 2 == 1  # a quoted field may hold line breaks
                            if size >= part_bytes and not open_quote:
                                out.close()
                                number, size, out = number + 1, 0, None
                        if out is not None:
                            out.close()
                yield pd.DataFrame({"path": [path], "json": [lines_of_json], "header": [header.decode("utf-8")]})

    return unpack


def read_zip_csv(spark: SparkSession, path: str, member: str | None = None, sep: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The named, else the first delimited or JSON-lines, member of every zip archive under ``path``; delimited text is all text, columns by the header.

    Archives are unpacked in parallel, as streams, once, into the shared folder, as parts that end with a record; the parts
    are then read like any other text, so neither an archive nor its content need fit in memory, and quoted fields may hold
    line breaks. All archives must have the header of the first. An archive with a header only gives no rows.
    """
    folder = f"{shared_folder(spark)}/zip-{uuid.uuid4().hex}"
    names = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    seen = names.repartition(max(1, names.count())).mapInPandas(_unpack(folder, member, part_bytes), "path string, json boolean, header string").orderBy("path").collect()  # a row per archive
    if not seen:
        raise ContractError(f"no archive at {path}")
    on_exit(spark, folder)
    if seen[0]["json"]:
        return spark.read.json(folder)
    if other := [r["path"] for r in seen if r["header"] != seen[0]["header"]]:
        raise ContractError(f"the header of {other[0]} isn't that of {seen[0]['path']}")
    sep = sep or sniff_delimiter(seen[0]["header"])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in next(csv.reader(io.StringIO(seen[0]["header"]), delimiter=sep))])
    if not exists(spark, folder) or not spark.read.format("binaryFile").load(folder).select("path").take(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(folder)


def first_available(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first of several places that exists and has a readable table; other faults are raised as they are."""
    tried = []
    for p in paths:
        if not any(c in p for c in "*?[{") and not exists(spark, p):
            tried.append(f"{p}: absent")
            continue
        try:
            return read_any(spark, p)
        except (AnalysisException, ContractError) as e:  # no such path, no columns, no reader
            tried.append(f"{p}: {str(e).splitlines()[0]}")
    raise ContractError("no source could be read: " + "; ".join(tried))


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``_line_number`` (1 for a file's first line, blank lines counted) and ``_file``; a line that isn't JSON has null fields.

    Lines are numbered within splits of the files, each of which starts at the lines before it; nothing is gathered.
    """
    text = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_at"), F.monotonically_increasing_id().alias("_order"))
    counts = text.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("n"))  # a row per split
    run = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_at", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_order"))
    x = text.withColumn("_in", within).join(starts, ["_file", "_at"]).where("trim(value) <> ''")
    return x.select(F.from_json("value", schema).alias("r"), (F.col("_in") + F.col("before")).alias("_line_number"), "_file").select("r.*", "_line_number", "_file")


def read_settings(spark: SparkSession, path: str) -> dict[str, object]:
    """A settings file of 'key: value' lines, nested by two or more spaces, with '- ' lists: the part of YAML such files use.

    Values are numbers, true, false, null or text, which may be quoted; '#' begins a comment. Anything else is an error.
    """
    return parse_settings("\n".join(r[0] for r in spark.read.text(path).collect()))


def parse_settings(text: str) -> dict[str, object]:
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in (_without_comment(y) for y in text.splitlines()) if x.strip() and x.strip() != "---"]

    def block(i: int, indent: int) -> tuple[object, int]:
        out: object = [] if lines[i][1].startswith("- ") else {}
        while i < len(lines) and lines[i][0] == indent:
            body = lines[i][1]
            if isinstance(out, list):
                if not body.startswith("- "):
                    raise ContractError(f"settings: list item expected: {body}")
                out.append(_scalar(body[2:]))
                i += 1
                continue
            key, colon, value = body.partition(":")
            if not colon:
                raise ContractError(f"settings: 'key: value' expected: {body}")
            i += 1
            if value.strip():
                out[key.strip().strip("\"'")] = _scalar(value)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("- ")):
                out[key.strip().strip("\"'")], i = block(i, lines[i][0])
            else:
                out[key.strip().strip("\"'")] = None
        if i < len(lines) and lines[i][0] > indent:
            raise ContractError(f"settings: unexpected indent: {lines[i][1]}")
        return out, i

    if not lines:
        return {}
    out, end = block(0, lines[0][0])
    if end < len(lines) or not isinstance(out, dict):
        raise ContractError(f"settings: unexpected line: {lines[min(end, len(lines) - 1)][1]}")
    return out


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str) -> object:
    s = text.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    if s.lower() in ("null", "~"):
        return None
    for number in (int, float):
        try:
            return number(s)
        except ValueError:
            pass
    return s


def read_metrics_json(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """path, dataset, mode, variant, metric, value from nested metric trees (tasks / dataset / mode / variant / metric)."""
    tree = F.from_json("value", "struct<tasks: map<string, map<string, map<string, string>>>>")
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), tree.alias("t")).select("path", F.explode("t.tasks").alias("dataset", "modes"))
    x = x.select("path", "dataset", F.explode("modes").alias("mode", "variants")).select("path", "dataset", "mode", F.explode("variants").alias("variant", "metrics"))
    names = list(names)
    return x.select("path", "dataset", "mode", "variant", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.get_json_object("metrics", f"$.{n}").try_cast("double").alias("value")) for n in names]))).where("value is not null")


def filing_rows(df: DataFrame, submissions: str, form: str, limit: int | None = None, key: str = "cik") -> DataFrame:
    """Filings of one form from submissions JSON of parallel arrays: key, cik (ten digits), filing columns, filing_url."""
    fields = ["accessionNumber", "filingDate", "acceptanceDateTime", "form", "primaryDocument", "primaryDocDescription"]
    recent = F.from_json(submissions, f"struct<filings: struct<recent: struct<{', '.join(f'{f}: array<string>' for f in fields)}>>>")
    x = df.select(F.col(key), recent.alias("s")).select(key, F.posexplode(F.arrays_zip(*[F.col(f"s.filings.recent.{f}").alias(f) for f in fields])).alias("place", "f")).where(F.col("f.form") == form)
    if limit is not None:
        x = x.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("rn") <= limit).drop("rn")
    accession = F.replace("f.accessionNumber", F.lit("-"), F.lit(""))
    url = F.format_string("https://www.sec.gov/Archives/edgar/data/%s/%s/%s", F.col(key).cast("long").cast("string"), accession, F.col("f.primaryDocument"))
    return x.select(F.lpad(F.col(key).cast("string"), 10, "0").alias("cik"), "place", accession.alias("accession_number"), "f.filingDate", "f.acceptanceDateTime", "f.form", "f.primaryDocument", "f.primaryDocDescription", url.alias("filing_url"))
