"""Writers. Rows are written by executors; only counts and small reports pass the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> int:
    """Write and return the number of rows, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = True) -> int:
    """One JSON object a line, nulls written out, keys sorted; returns the number of rows."""
    seen = Observation()
    columns = sorted(df.columns) if sort_keys else df.columns
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).alias("value")
    df.select(line).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame) -> str:
    """A one-row table as an indented JSON document with sorted keys."""
    row = df.limit(1).first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, sort_keys=True, default=str)


def report_markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as markdown; ``most`` bounds the rows shown, and a note says if there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(out + ["", f"More than {most} rows; the rest isn't shown."] * (len(rows) > most)) + "\n"


def fingerprint(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of every file under ``paths``, sorted; what a stage's inputs are told apart by."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def materialise(spark: SparkSession, path: str, config: object, build: Callable[[], DataFrame], force: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """The table at ``path``, built only if it isn't complete or was built under another configuration or from other input files."""
    jvm = spark._jvm
    what = [config, fingerprint(spark, inputs or [])]
    digest = hashlib.sha1(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_BUILT_{digest}")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if force or not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
        fs.create(done, True).close()
    return spark.read.parquet(path)


def limited(df: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` rows (all if None or 0); a limit the caller asks for."""
    return df.limit(most) if most else df


def export_dataset(df: DataFrame, folder: str, columns: dict[str, str], source: str, split: str, most: int | None = None) -> dict[str, object]:
    """Instruction, input and output (or whatever ``columns`` names: field -> column) of a dataset as JSON lines, with its metadata beside them.

    Null fields become empty text; rows without an instruction and an output are left out. Returns the metadata: rows, source, split, columns.
    """
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f) for f, c in columns.items()]
    x = df.select(*fields)
    if {"instruction", "output"} <= columns.keys():
        x = x.where("trim(instruction) <> '' or trim(output) <> ''")
    x = limited(x.withColumns({"source_dataset": F.lit(source), "source_split": F.lit(split)}), most)
    meta = {"rows": write_jsonl(x, f"{folder}/records", sort_keys=False), "source": source, "split": split, "columns": dict(columns)}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return meta


def confusion_long(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """keys, gold, pred, n for every pair of known labels (0 where none) and for invalid predictions, in that order of labels."""
    from skarn.operators.evaluate import INVALID, confusion

    c = confusion(df, keys)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("gold"), F.lit(b).alias("pred")) for i, (a, b) in enumerate((a, b) for a in labels for b in [*labels, INVALID])]))
    every = df.select(*keys).distinct().select(*keys, grid.alias("g")).select(*keys, "g.*") if keys else df.limit(1).select(grid.alias("g")).select("g.*")
    return every.join(c, [*keys, "gold", "pred"], "left").select(*keys, "place", "gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def report_sections(title: str, sections: dict[str, DataFrame | str], most: int = 200) -> str:
    """A markdown report of several tables or paragraphs under headings, in order."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        text = body if isinstance(body, str) else report_markdown(body, name, most).split("\n", 2)[2]
        out += [f"## {name}", "", text.rstrip("\n"), ""]
    return "\n".join(out)


def write_bundle(df: DataFrame, card: DataFrame, folder: str, without: tuple[str, ...] = ()) -> int:
    """A candidate set: its records as JSON lines under ``records`` and its card as a table under ``card``; returns the records."""
    n = write_jsonl(df.drop(*without), f"{folder}/records")
    card.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/card")
    return n


def human_size(n: int | float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError
