"""Deterministic splits, samples and set comparisons.

Random order is the order of md5(key # seed): the same on any layout, cluster or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.session import cut


def hash_order(*keys: Column, seed: int | str = 0) -> Column:
    return F.md5(F.concat_ws("#", *[k.cast("string") for k in keys], F.lit(str(seed))))


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank (1 for the first by ``order``; ties share it) and n, the number of rows, without gathering them.

    Rows are range-partitioned by ``order`` and kept as they fell; a partition is ranked on its own and starts at the
    number of rows before it. Only rows with equal order values must share a task.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))  # a row per partition
    run = counts.select("__part", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(F.lit(0))).alias("n"))
    within = F.rank().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__in", within).join(run, "__part").withColumn("rank", F.col("__before") + F.col("__in")).drop("__before", "__in", "__part")


def chronological_split(df: DataFrame, day: str, order: list[str], train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """Adds split: 'train', 'val' or 'test' by percent rank (0 for a single row) against train and train + validation.

    Only the ordering columns are ranked; two of their values, where 'val' and 'test' begin, then divide the table, whose other
    columns neither move nor are written. Null days come first.
    """
    keys = [day, *order]
    ranked = global_rank(df.select(*keys), keys)
    pr = F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    at = F.struct(*keys)
    begins = cut(ranked.agg(*[F.min(F.when(pr >= x, at)).alias(n) for n, x in (("val", train), ("test", train + validation))]))  # one row
    before = lambda n: (lambda b: b.isNull() | (at < b))(begins.select(n).scalar())
    return df.withColumn("split", F.when(before("val"), "train").when(before("test"), "val").otherwise("test"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows of least hash (all if 0); taken per partition first, so only n rows a task meet."""
    return df.orderBy(hash_order(F.col(key), seed=seed), key).limit(n) if n else df


def hash_fraction(key: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) per key: the first 32 bits of its hash."""
    return F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def held_out(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds held_out: about ``fraction`` of the keys, whatever else the table holds; all rows of a key agree."""
    return df.withColumn("held_out", hash_fraction(F.col(key), seed) < fraction)


def source_mix(df: DataFrame, source: str, label: str, key: str, sig: Column, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """Per source, quotas of rows per label, by hash, one row per signature; labels without a quota give none."""
    one = Window.partitionBy(source, "__sig").orderBy(hash_order(F.col(key), seed=seed), key)
    pick = Window.partitionBy(source, label).orderBy(hash_order(F.col(key), seed=seed), key)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    x = df.where(F.col(label).isin(list(quotas))).withColumn("__sig", sig).withColumn("__rn", F.row_number().over(one)).where("__rn = 1")
    return x.withColumn("__rn", F.row_number().over(pick)).where((F.col("__rn") <= max(quotas.values())) & (F.col("__rn") <= quota[F.col(label)])).drop("__rn", "__sig")


def sequential_splits(df: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """The first rows in hash order cut into splits of given sizes, in order; adds split."""
    total = sum(n for _, n in sizes)
    top = hash_sample(df, key, total, seed)
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(F.col(key), seed=seed), key))  # over the sample only
    label, upto = None, 0
    x = top.withColumn("__rn", rn)
    for name, n in sizes:
        upto += n
        label = F.when(F.col("__rn") <= upto, name) if label is None else label.when(F.col("__rn") <= upto, name)
    return x.withColumn("split", label).drop("__rn")


def quota_per_group(df: DataFrame, groups: list[str], quota: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``quota`` rows a group, by hash."""
    w = Window.partitionBy(*groups).orderBy(hash_order(F.col(key), seed=seed), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= quota).drop("__rn")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows a group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def split_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that stand in more than one split: key, splits, list of splits."""
    per = df.where(F.col(key).isNotNull()).select(key, split).distinct().groupBy(key)
    return per.agg(F.count(F.lit(1)).alias("splits"), F.array_join(F.array_sort(F.collect_list(split)), ",").alias("split_list")).where("splits > 1")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def reuse_rate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """added (distinct keys of b not in a), total (distinct keys of b), shared, reuse_rate (four places)."""
    both = b.select(key).distinct().join(a.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return both.agg(F.count_if(F.col("__in").isNull()).alias("added"), F.count(F.lit(1)).alias("total"), F.count("__in").alias("shared"), F.round(1 - F.count_if(F.col("__in").isNull()) / F.count(F.lit(1)), 4).alias("reuse_rate"))
