"""Spark session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skarn", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects: UTC, adaptive execution, ANSI left on.

    On a cluster the submitting side sets master and memory; only the three SQL settings matter there.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKARN_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def doctor(spark: SparkSession) -> dict[str, object]:
    """Versions, the settings the engine relies on, and whether a job with a Python worker and a shuffle runs."""
    import platform

    seen = spark.range(1000).mapInPandas(lambda it: it, "id long").repartition(3).selectExpr("sum(id) as s").first()["s"]
    keys = ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.checkpoint.dir")
    return {"spark": spark.version, "python": platform.python_version(), "works": seen == 499_500, **{k: spark.conf.get(k, None) for k in keys}}


_CUTS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names, which all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
            folder = tempfile.mkdtemp(prefix="skarn-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the folder ``spark.checkpoint.dir`` names and read it from there.

    The folder is shared by all executors, so a lost executor loses nothing, and the table is compressed, which a
    checkpoint isn't. Where the setting is absent a temporary folder is used, but only on a local master; on a cluster
    a missing setting is an error. Tables are removed by ``release`` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    _CUTS.append((spark, path))
    return out


def on_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the program ends."""
    _CUTS.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and nothing will read again."""
    for df in frames:
        if path := getattr(df, "_skarn_path", None):
            _delete(df.sparkSession, path)
            _CUTS[:] = [x for x in _CUTS if x[1] != path]


@atexit.register
def _release_all() -> None:
    for spark, path in _CUTS:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone
            return
