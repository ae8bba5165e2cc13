"""Attributes as known at event time.

Every version of an entity's attributes is a rectangle: the days it is valid by the days it is on record. Where
rectangles overlap, one version is current (the one that ranks highest), so the plane of an entity splits into
disjoint regions of one current version each, and an event, a point (valid day, recorded day), lies in at most one.

The plane is cut by a grid. Only cells that hold a point are built, and rectangles are clipped to their cell and
collapsed there to the best-ranked version per clipped shape before any list is gathered, so the list of a cell is
bounded by the shapes that fit in it however many versions an entity has. Versions are filed in the columns of the grid they
touch, within the columns that hold points at all, and meet cells by an equi-join on (entity, column), so an entity with very
many versions is spread too. Points and regions meet by an equi-join on (entity, cell) with a residual range test; an entity that holds a third of all events is spread over its cells, and a
cell that is still too large is one that adaptive execution can split, since the regions' side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.session import cut

#: Day numbers standing for open ends.
DAY_MIN, DAY_MAX = -719162, 2932896  # 0001-01-01 and 9999-12-31, fixed values of the calendar

#: Width of a grid cell in days, on either axis.
CELL_DAYS = 256


def _cell(day: Column | str, width: int) -> Column:
    return F.floor((F.col(day) if isinstance(day, str) else day) / F.lit(width)).cast("long")


def regions(versions: DataFrame, cells: DataFrame, width: int = CELL_DAYS) -> DataFrame:
    """Disjoint regions of one current version each, per cell.

    ``versions``: k, v1, v2, r1, r2 (inclusive days), p (struct; the largest wins). ``cells``: k, vc, rc.
    Returns k, vc, rc, va, vb, ra, rb, p.
    """
    cells = cut(cells)  # found once, for the bounds and for the join
    ends = cells.agg(F.min("vc").alias("a"), F.max("vc").alias("b")).first()  # two numbers
    if ends["a"] is None:
        versions, ends = versions.where("false"), {"a": 0, "b": 0}
    filed = versions.withColumns({"a": F.greatest(_cell("v1", width), F.lit(ends["a"])), "b": F.least(_cell("v2", width), F.lit(ends["b"]))})
    filed = filed.where("a <= b").select("k", "v1", "v2", "r1", "r2", "p", F.explode(F.sequence("a", "b")).alias("vc"))
    v0, r0 = F.col("vc") * width, F.col("rc") * width
    v9, r9 = v0 + (width - 1), r0 + (width - 1)
    clipped = (
        cells.join(filed, ["k", "vc"])
        .where((F.col("r1") <= r9) & (F.col("r2") >= r0))
        .groupBy("k", "vc", "rc", F.greatest("v1", v0).alias("v1"), F.least("v2", v9).alias("v2"), F.greatest("r1", r0).alias("r1"), F.least("r2", r9).alias("r2"))
        .agg(F.max("p").alias("p"))
    )
    lists = clipped.groupBy("k", "vc", "rc").agg(F.collect_list(F.struct("v1", "v2", "r1", "r2", "p")).alias("c"))
    slabs = lists.withColumn("cut", F.expr("array_sort(array_distinct(flatten(transform(c, x -> array(x.v1, x.v2 + 1)))))")).selectExpr(
        "k", "vc", "rc", "inline(transform(slice(cut, 1, size(cut) - 1), (s, i) -> struct(s as va, cut[i + 1] - 1 as vb, filter(c, x -> x.v1 <= s and x.v2 >= s) as m)))"
    )
    return (
        slabs.where("size(m) > 0")
        .withColumn("cut", F.expr("array_sort(array_distinct(flatten(transform(m, x -> array(x.r1, x.r2 + 1)))))"))
        .selectExpr(
            "k", "vc", "rc", "va", "vb",
            "inline(transform(slice(cut, 1, size(cut) - 1), (s, i) -> struct(s as ra, cut[i + 1] - 1 as rb, array_max(transform(filter(m, x -> x.r1 <= s and x.r2 >= s), x -> x.p)) as p)))",
        )
        .where("p is not null")
    )


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_key: Column,
    event_day: Column,
    known_day: Column,
    version_key: Column,
    valid_from: Column,
    valid_to: Column,
    recorded_from: Column,
    recorded_to: Column | None = None,
    rank: list[Column],
    payload: list[str],
    width: int = CELL_DAYS,
) -> DataFrame:
    """``events`` with a struct column ``known``: the attributes current for the event's entity at its point.

    Days are DATE columns. The version current at a point is the one, among those valid on ``event_day`` and on
    record on ``known_day``, whose ``rank`` columns are largest, compared in order; further ties fall to the
    largest payload. Events with a null key or day, and points no version covers, get a null ``known``.
    Versions with a null key, null start or null rank are ignored, as are those whose end precedes the start; a null
    end is open. Repeated versions and repeated events change nothing and lose nothing. Empty inputs give an empty or
    null-filled result. Extra columns of ``events`` pass through; those of ``versions`` are dropped, so names can't
    clash (only ``known`` and names beginning with two underscores are reserved).
    """
    day = F.unix_date
    end = lambda c: F.coalesce(day(c), F.lit(DAY_MAX)) if c is not None else F.lit(DAY_MAX)
    v = versions.select(
        version_key.alias("k"),
        day(valid_from).cast("long").alias("v1"), end(valid_to).cast("long").alias("v2"),
        day(recorded_from).cast("long").alias("r1"), end(recorded_to).cast("long").alias("r2"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)], F.struct(*payload).alias("a")).alias("p"),
    ).where("k is not null and v1 <= v2 and r1 <= r2")
    for i in range(len(rank)):
        v = v.where(F.col(f"p.o{i}").isNotNull())
    e = events.withColumns({"__k": event_key, "__v": day(event_day).cast("long"), "__r": day(known_day).cast("long")})
    e = e.withColumns({"__vc": _cell("__v", width), "__rc": _cell("__r", width)})
    points = e.where("__k is not null and __v is not null and __r is not null")
    cells = points.select(F.col("__k").alias("k"), F.col("__vc").alias("vc"), F.col("__rc").alias("rc")).distinct()
    found = regions(v, cells, width)
    found = found.select(*[F.col(c).alias(f"__f_{c}") for c in found.columns])
    f = lambda c: F.col(f"__f_{c}")
    hit = (F.col("__k") == f("k")) & (F.col("__vc") == f("vc")) & (F.col("__rc") == f("rc")) & F.col("__v").between(f("va"), f("vb")) & F.col("__r").between(f("ra"), f("rb"))
    return e.join(found, hit, "left").select(*[F.col(f"`{c}`") for c in events.columns], f("p")["a"].alias("known"))
