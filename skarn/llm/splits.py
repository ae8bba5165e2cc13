"""Splits that keep related records together.

Records are nodes of a graph with the things they share; components of it are indivisible. Their weights are balanced
by the largest-differencing method into many equal bins: take the two partial solutions with the largest difference
between their heaviest and lightest bin, and join them heaviest to lightest, until one is left. Shards of components
are balanced on their own (each a partial solution of as many bins) and the shards' solutions are joined the same
way, so only shards x bins sums ever meet in one task. Whole bins then go to splits by target proportion.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.components import connected_components
from skarn.session import cut

#: Bins that are filled equally and then dealt to splits; one bin is half a percent of the whole.
BINS = 200
#: Components balanced in one task.
SHARD_COMPONENTS = 1_000_000


def largest_differencing(rows: np.ndarray) -> np.ndarray:
    """The bin of every entry of ``rows`` (partial solutions x bins), entries of one row in different bins."""
    n, b = rows.shape
    if n == 0:
        return np.zeros((0, b), np.int64)
    tree: list[tuple] = []  # (left, right, slots of left, slots of right); nodes under n are rows
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i in range(n):
        sums[i] = rows[i]
        heap.append((-(rows[i].max() - rows[i].min()), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        si, sj = sums.pop(i), sums.pop(j)
        oi, oj = np.argsort(-si, kind="stable"), np.argsort(sj, kind="stable")
        k = n + len(tree)
        tree.append((i, j, oi, oj))
        sums[k] = si[oi] + sj[oj]
        heapq.heappush(heap, (-(sums[k].max() - sums[k].min()), k))
    out = np.zeros((n, b), np.int64)
    stack = [(heap[0][1], np.arange(b))]  # a node and the bin of each of its slots
    while stack:
        k, bins = stack.pop()
        if k < n:
            out[k] = bins
            continue
        i, j, oi, oj = tree[k - n]
        for child, order in ((i, oi), (j, oj)):
            at = np.empty(b, np.int64)
            at[order] = bins
            stack.append((child, at))
    return out


def deal_bins(weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split of every bin: heaviest first, to the split that lacks most of its target."""
    shares = np.maximum(np.nan_to_num(shares), 0)
    lack = weights.sum() * shares / max(shares.sum(), 1e-300)
    out = np.zeros(len(weights), np.int64)
    for i in np.argsort(-weights, kind="stable"):
        out[i] = int(np.argmax(lack))
        lack[out[i]] -= weights[i]
    return out


def _balance_shard(pdf: pd.DataFrame, bins: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
    w = np.zeros(-(-len(pdf) // bins) * bins)
    w[: len(pdf)] = pdf["weight"]
    return pdf.assign(slot=largest_differencing(w.reshape(-1, bins)).ravel()[: len(pdf)])[["component", "weight", "shard", "slot"]]


def assign_components(weights: DataFrame, targets: DataFrame, bins: int = BINS, shard_components: int = SHARD_COMPONENTS) -> DataFrame:
    """component, weight, split. ``weights``: component, weight. ``targets``: split, target_share.

    Targets are few, a row per split, and read by the driver. A component is never cut; one heavier than a split's target still lies in one split, and the other splits share
    the rest. Null, negative or absent shares count as 0; without usable targets no component gets a split.
    """
    t = [(r[0], float(r[1] or 0)) for r in targets.where("split is not null").groupBy("split").agg(F.max("target_share")).orderBy(F.desc("max(target_share)"), "split").collect()]
    names, shares = [x for x, _ in t], np.array([s for _, s in t])
    shards = max(1, -(-weights.count() // shard_components))
    in_slots = cut(
        weights.withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(lambda pdf: _balance_shard(pdf, bins), "component string, weight long, shard int, slot int")
    )

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["shard"].unique())
        grid = np.zeros((len(ids), bins))
        row = np.searchsorted(ids, pdf["shard"])
        grid[row, pdf["slot"]] = pdf["weight"]
        if not names:
            return pdf.assign(split=None)[["shard", "slot", "split"]]
        of = largest_differencing(grid)
        split = deal_bins(np.bincount(of.ravel(), grid.ravel(), bins), shares)
        return pdf.assign(split=[names[k] for k in split[of[row, pdf["slot"]]]])[["shard", "slot", "split"]]

    # shards x bins rows, however many components there are
    dealt = in_slots.groupBy("shard", "slot").agg(F.sum("weight").alias("weight")).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(deal, "shard int, slot int, split string")
    return in_slots.join(dealt, ["shard", "slot"], "left").select("component", "weight", "split")


def split_entities(records: DataFrame, record_id: str, shared: list[Column], targets: DataFrame, tie_repeats: bool = True, **options: int) -> tuple[DataFrame, DataFrame]:
    """(assigned, nodes). assigned: id, component, split: one row per distinct non-null ``record_id``. nodes: node, component, split.

    A node is a key with the number of its column before it ('0:XEGXBB'). Records that agree in any of ``shared`` (string
    keys; null joins nothing), directly or through a chain, lie in one split. A record without any key is its own
    component. With ``tie_repeats`` rows that repeat a record id are one record, which joins everything its rows name; without,
    such a record goes with the least of its keys. A row without an id ties its keys, but is no record. An empty table gives
    no rows; other columns are ignored, so names can't clash.
    """
    names = [f"k{i}" for i in range(len(shared))]
    keyed = records.select(F.col(record_id).cast("string").alias("id"), *[F.concat(F.lit(f"{i}:"), c).alias(n) for i, (n, c) in enumerate(zip(names, shared))])
    keyed = keyed.withColumn("first", F.coalesce(*names, F.concat(F.lit("r:"), F.col("id")))).where("first is not null")
    edges = keyed.select("first", *names).distinct().select(F.col("first").alias("a"), F.explode(F.array(*names)).alias("b")).where("b is not null").distinct()
    # the only shuffle of all records; everything below it is narrow
    per = cut(keyed.where("id is not null").groupBy("id").agg(F.min("first").alias("first"), F.max("first").alias("last")))
    if tie_repeats:
        # a record whose rows name different keys ties those together; only such records need edges of their own
        torn = per.where("first <> last").select("id", F.col("first").alias("a"))
        chains = torn.join(keyed.select("id", "first").distinct(), "id").where("first <> a").select("a", F.col("first").alias("b")).distinct()
        edges = edges.unionByName(chains)
    comp = cut(connected_components(edges))
    # keys are counted before they meet their components, so a hot key sends a row a task
    keys = per.groupBy("first").agg(F.count(F.lit(1)).alias("n")).join(comp.withColumnRenamed("node", "first"), "first", "left")
    weights = cut(keys.groupBy(F.coalesce("component", "first").alias("component")).agg(F.sum("n").alias("weight")))
    dealt = cut(assign_components(weights, targets, **options).drop("weight"))
    nodes = comp.join(dealt, "component", "left").select("node", "component", "split")
    alone = dealt.where("component like 'r:%'").select(F.col("component").alias("first"), "component", "split")
    of_key = nodes.withColumnRenamed("node", "first").unionByName(alone)
    return per.select("id", "first").join(of_key, "first").select("id", "component", "split"), nodes


def grouped_splits(records: DataFrame, record_id: str, shared: list[Column], targets: DataFrame, **options: int) -> DataFrame:
    """record id, component, split: what split_entities assigns."""
    return split_entities(records, record_id, shared, targets, **options)[0].withColumnRenamed("id", record_id)
