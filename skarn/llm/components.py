"""Connected components of a large graph by alternating large-star and small-star steps.

The steps shrink the graph; what is left once it has at most ONE_TASK_EDGES edges is solved by union-find in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.session import cut, release

#: A node is hot when it has at least this many edges and at least a thousandth of all; so at most 2,000 are.
HOT_EDGES = 20_000
#: Edges of a graph that one task solves.
ONE_TASK_EDGES = 500_000


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    up: dict[str, str] = {}

    def top(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(edges["u"], edges["v"]):
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return pd.DataFrame({"node": [*up], "component": [top(x) for x in up]})


def _with_minimum(edges: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (u, v) with m, the least neighbour of u.

    The minima have one row per node. Those of hot nodes, of which the threshold allows 2,000, are broadcast, so a
    node with a third of all edges isn't gathered in one task; the rest meet in a shuffled join.
    """
    mins = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    hot_at = max(HOT_EDGES, n_edges // 1000)
    if n_edges < hot_at:
        return edges.join(mins.drop("deg"), "u")
    hot = mins.where(F.col("deg") >= hot_at).drop("deg")
    cold = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(mins.where(F.col("deg") < hot_at).drop("deg"), "u")
    return cold.unionByName(edges.join(F.broadcast(hot), "u"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns a, b (strings). Returns node, component: the least node of its component.

    Edges with a null end are ignored; loops and repeated edges change nothing; an empty graph gives no rows. Every
    round is written to the shared folder; the rounds grow with the logarithm of the number of nodes.
    """
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = cut(e.where("u <> v").distinct())
    n, seen = e.count(), None
    stars: DataFrame | None = None
    for _ in range(max_rounds):
        if n <= ONE_TASK_EDGES:
            stars = e.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: _solve(pdf), "node string, component string")
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_minimum(large, n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.distinct())
        release(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        n = now[0]
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    if stars is None:
        stars = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    stars = cut(stars)
    alone = loops.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionByName(alone)
