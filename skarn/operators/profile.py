"""One-pass profiles, distributions and duplicate counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.session import cut


def _per_column(df: DataFrame, exprs: dict[str, Column], value: str) -> DataFrame:
    """One aggregation over the table, turned into a row per column."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[e.alias(f"v{i}") for i, e in enumerate(exprs.values())])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias(value)) for i, c in enumerate(exprs)])
    return wide.select("rows", F.inline(pairs))


def null_rates(df: DataFrame, columns: list[str] | None = None, blank_is_null: bool = True) -> DataFrame:
    """column_name, null_rate (six places; 0 on an empty table), rows."""
    kinds = dict(df.dtypes)
    missing = lambda c: (F.col(c).isNull() | (F.trim(c) == "")) if blank_is_null and kinds[c] == "string" else F.col(c).isNull()
    exprs = {c: F.coalesce(F.round(F.avg(missing(c).cast("double")), 6), F.lit(0.0)) for c in (columns or df.columns)}
    return _per_column(df, exprs, "null_rate")


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, first_day, last_day as text, rows."""
    day = lambda f, c: F.date_format(f(F.to_date(c)), "yyyy-MM-dd")
    exprs = {c: F.struct(day(F.min, c).alias("first_day"), day(F.max, c).alias("last_day")) for c in columns}
    return _per_column(df, exprs, "r").select("column_name", "r.first_day", "r.last_day", "rows")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, distinct_values (exact), rows."""
    return _per_column(df, {c: F.count_distinct(c) for c in columns}, "distinct_values")


def manifest(df: DataFrame, date_columns: list[str]) -> DataFrame:
    """column_name, type, rows, null_rate, first_day, last_day: the whole profile in one pass."""
    kinds = dict(df.dtypes)
    day = lambda f, c: F.date_format(f(F.to_date(c)), "yyyy-MM-dd") if c in date_columns else F.lit(None).cast("string")
    missing = lambda c: (F.col(c).isNull() | (F.trim(c) == "")) if kinds[c] == "string" else F.col(c).isNull()
    exprs = {c: F.struct(F.lit(kinds[c]).alias("type"), F.coalesce(F.round(F.avg(missing(c).cast("double")), 6), F.lit(0.0)).alias("null_rate"), day(F.min, c).alias("first_day"), day(F.max, c).alias("last_day")) for c in df.columns}
    return _per_column(df, exprs, "p").select("column_name", "p.*", "rows")


def funnel_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """rows_in, one count per condition, and rows_kept (all conditions), from a single aggregation."""
    every = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in steps.values()])
    return df.agg(F.count(F.lit(1)).alias("rows_in"), *[F.count_if(c).alias(n) for n, c in steps.items()], F.count_if(every).alias("rows_kept"))


def frequency(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, value, n for many columns in one shuffle; nulls count as 'UNK'."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("UNK")).alias("value")) for d in dims])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def top_share(df: DataFrame, dims: list[str], k: int = 10) -> DataFrame:
    """dimension, value, n, share (four places): the k most frequent values, ties by value."""
    f = frequency(df, dims)
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = f.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.select("dimension", "value", "n", F.round(F.col("n") / total, 4).alias("share"))


def entropy_bits(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, values, entropy (bits, four places); from grouped counts, so no window holds a dimension."""
    f = frequency(df, dims)
    # H = log2(N) - sum(n log2 n) / N
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return f.groupBy("dimension").agg(F.count(F.lit(1)).alias("distinct_values"), F.round(h, 4).alias("entropy"))


def length_summary(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(F.length(text)), 2).alias("mean_chars"), F.min(F.length(text)).alias("min_chars"), F.max(F.length(text)).alias("max_chars"))


#: Accuracy of the sketch nearest_rank brackets a percentile by, and the bracket's half width in its errors.
SKETCH_ACCURACY, SKETCH_MARGIN = 1000, 5


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """keys, n and p<percent> columns: the value at index round_half_even((n - 1) p) of a group's sorted values; nulls are left out.

    Exact, and no group is sorted in one task: a mergeable sketch brackets every wanted value between two, a partial
    aggregation counts what lies below a bracket, and only the distinct values inside brackets (about a hundredth of the rows)
    are shuffled and ranked. The margin is five times the sketch's greatest error.
    """
    v = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("k"), F.col(value).alias("v"))
    slack = SKETCH_MARGIN / SKETCH_ACCURACY
    edges = [min(1.0, max(0.0, p + d)) for p in percents for d in (-slack, slack)]
    sketch = v.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", edges, SKETCH_ACCURACY).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    bracket = F.array(*[
        F.struct(
            F.lit(i).alias("p"), F.bround((F.col("n") - 1) * F.lit(p), 0).cast("long").alias("at"),
            (F.col("least") if p <= slack else F.col("e")[2 * i]).alias("a"), (F.col("most") if p >= 1 - slack else F.col("e")[2 * i + 1]).alias("b"),
        ) for i, p in enumerate(percents)
    ])
    wanted = cut(sketch.select("k", "n", bracket.alias("brackets")))  # a row per group
    x = v.join(wanted, "k")
    below = x.groupBy("k").agg(*[F.count_if(F.col("v") < F.col("brackets")[i]["a"]).alias(f"b{i}") for i in range(len(percents))])
    below = below.select("k", F.inline(F.array(*[F.struct(F.lit(i).alias("p"), F.col(f"b{i}").alias("before")) for i in range(len(percents))])))
    inside = x.select("k", "v", F.explode(F.filter("brackets", lambda s: (s["a"] <= F.col("v")) & (F.col("v") <= s["b"]))).alias("s")).groupBy("k", "s.p", "s.at", "v").agg(F.count(F.lit(1)).alias("c"))
    run = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = run.join(below, ["k", "p"]).where(F.col("upto") + F.col("before") > F.col("at")).groupBy("k", "p").agg(F.min("v").alias("v"))
    wide = hit.groupBy("k").agg(*[F.max(F.when(F.col("p") == i, F.col("v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(percents)])
    return wide.join(wanted.select("k", "n"), "k").select("k.*", "n", *[f"p{round(p * 100)}" for p in percents])


def duplicate_rate(df: DataFrame, keys: list[str], sig: Column) -> DataFrame:
    """keys, rows, duplicates (rows beyond the first of a signature), rate (four places)."""
    g = df.groupBy(*keys, sig.alias("__sig")).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys)
    return g.agg(F.sum("c").alias("rows"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates"), F.round((F.sum("c") - F.count(F.lit(1))) / F.sum("c"), 4).alias("rate"))


def dataset_card(df: DataFrame, dims: list[str], sig: Column, text: str) -> DataFrame:
    """section, name, value: rows, duplicates, mean length, and per dimension its distinct values, entropy and top share."""
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    d = duplicate_rate(df, [], sig).select(F.inline(F.array(row("all", F.lit("rows"), F.col("rows")), row("all", F.lit("duplicate_rate"), F.col("rate")))))
    n = length_summary(df, [], text).select(F.inline(F.array(row("all", F.lit("mean_chars"), F.col("mean_chars")))))
    f = frequency(df, dims).groupBy("dimension").agg(F.count(F.lit(1)).alias("v"), F.round(F.max("n") / F.sum("n"), 4).alias("t"), F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 4).alias("e"))
    parts = F.array(*[F.struct(F.lit(s).alias("section"), F.col("dimension").alias("name"), F.col(c).cast("double").alias("value")) for s, c in (("distinct", "v"), ("top_share", "t"), ("entropy", "e"))])
    return d.unionByName(n).unionByName(f.select(F.inline(parts)))


def shares(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, value, n, share (four places) of every value of several columns; nulls count as 'UNK'."""
    f = frequency(df, dims)
    return f.withColumn("share", F.round(F.col("n") / df.agg(F.count(F.lit(1))).scalar(), 4))


def coverage_growth(old: DataFrame, new: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, before, after, added and reuse_rate: distinct values of ``old``, of ``new``, those only in ``new``, and the share of new's values that aren't.

    All columns in one aggregation of (dimension, value); nulls count nowhere.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).cast("string").alias("v")) for x in dims]))
    both = old.select(F.lit(False).alias("__new"), pairs).unionByName(new.select(F.lit(True).alias("__new"), pairs)).where("v is not null")
    per = both.groupBy("dimension", "v").agg(F.bool_or(~F.col("__new")).alias("o"), F.bool_or("__new").alias("n"))
    added, after = F.count_if(F.col("n") & ~F.col("o")), F.count_if("n")
    return per.groupBy("dimension").agg(F.count_if("o").alias("before"), after.alias("after"), added.alias("added"), F.round(1 - F.try_divide(added, after), 4).alias("reuse_rate"))
