"""Cleaning and labelling expressions. Bad input gives null, never an error, with ANSI mode on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Outer spaces removed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """blank_to_null on many columns in one projection."""
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns})


def id_prefix(c: Column, n: int = 8) -> Column:
    """The first ``n`` characters in upper case."""
    return F.upper(F.substring(c, 1, n))


def safe_number(c: Column, kind: str = "double") -> Column:
    return c.try_cast(kind)


def safe_date(c: Column) -> Column:
    """A DATE from ISO text; anything else is null."""
    return F.try_to_date(c)


def composite_key(*cs: Column, missing: str = "UNK") -> Column:
    """Parts joined by '|', a null part as ``missing``."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in cs])


def pct_change(delta: Column, prior: Column, tiny: float = 1e-9) -> Column:
    """delta / |prior|; null without a prior or with one next to zero."""
    return F.when(F.abs(prior) >= tiny, delta / F.abs(prior))


def direction_label(delta: Column, neutral: float = 0.005) -> Column:
    """'neutral' below the threshold and for null, else the sign."""
    return F.when(delta.isNull() | (F.abs(delta) < neutral), "neutral").when(delta > 0, "positive").otherwise("negative")


def magnitude_bucket(delta: Column, pct: Column, neutral: float = 0.005, pct_edges: tuple[float, float] = (0.05, 0.15), abs_edges: tuple[float, float] = (0.05, 0.25)) -> Column:
    """'unknown', 'flat', 'small', 'medium' or 'large', by percentage where there is one, else by amount."""
    size = lambda x, e: F.when(x < e[0], "small").when(x < e[1], "medium").otherwise("large")
    return F.when(delta.isNull(), "unknown").when(F.abs(delta) < neutral, "flat").when(pct.isNotNull(), size(F.abs(pct), pct_edges)).otherwise(size(F.abs(delta), abs_edges))


def realized_direction(ret: Column, edge: float = 0.01) -> Column:
    return F.when(ret.isNull(), "unknown").when(F.abs(ret) < edge, "neutral").when(ret > 0, "positive").otherwise("negative")


def realized_magnitude(ret: Column, edge: float = 0.01, large: float = 0.05) -> Column:
    return F.when(ret.isNull(), "unknown").when(F.abs(ret) < edge, "flat").when(F.abs(ret) < large, "small").otherwise("large")


def alignment(expected: Column, realized: Column) -> Column:
    """'unobserved', 'aligned', 'mixed' (either side neutral) or 'contrarian'."""
    return F.when(realized == "unknown", "unobserved").when(expected == realized, "aligned").when((expected == "neutral") | (realized == "neutral"), "mixed").otherwise("contrarian")


def scalar_text(c: Column, kind: str) -> Column:
    """A value ready for JSON: dates as ISO text, doubles to six places with NaN as null, the rest as is."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(c), F.round(c, 6))
    return F.date_format(c, "yyyy-MM-dd") if kind == "date" else c
