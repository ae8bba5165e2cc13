"""Normalised join keys. Null and blank inputs give null, so they never join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Outer white space removed, no-break spaces included; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""), F.lit(""))


def folded(c: Column) -> Column:
    """Lower case without outer spaces; blank becomes null."""
    return F.lower(stripped(c))


def numeric_key(c: Column) -> Column:
    """An identifier without outer spaces and leading zeros ('006751', ' 6751' -> '6751'; '000' -> '0')."""
    s = stripped(c)
    bare = F.regexp_replace(s, "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def six_digits(c: Column) -> Column:
    """The printed form of a numeric key: padded to six characters, longer keys left as they are."""
    return F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)


def ticker_root(c: Column) -> Column:
    """Upper case, no outer spaces, no final dot plus one or two letters ('xegxbb.n ' -> 'XEGXBB')."""
    return F.nullif(F.regexp_replace(F.upper(stripped(c)), r"\.\p{L}{1,2}$", ""), F.lit(""))
