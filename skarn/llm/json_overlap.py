"""Same or near-same records across splits.

Two records are near the same if at most ``max_diff`` leaf values of their JSON differ. A record's normalised text is
a row of short codes, one per leaf, dealt into ``max_diff`` + 1 passages, so near-same records agree in one passage at
least, whatever differs elsewhere. The passages of evaluation records are sharded by content and loaded into one
Aho-Corasick automaton per shard, which scans whole training texts and gives the intervals it finds; a text goes to the
shards its own passages fall in, once each, and no other shard could find anything in it. Intervals are merged into the
coverage of a pair and of an evaluation record; pairs that share an interval are compared leaf by leaf.

A passage that very many records share (say, where all its leaves are missing) would make nearly all of them candidates, so
such hot passages are searched again, joined to parts of the others. Let two records agree in ``m`` passages, all hot. Each of
the others holds a difference, so none holds more than ``m``, and of ``m`` + 1 parts of it one agrees. For every choice of
``m`` of a record's hot passages these are joined to every choice of one of ``m`` + 1 parts of each other passage.

Numbers within a tolerance of each other must give one code. A training number is written as the cell of a grid much
wider than the tolerance; an evaluation number as the one or two cells that the tolerance reaches. Passages are made of
the most varied leaves, at most PASSAGE_LEAVES each, which bounds these spellings; the other leaves take part in the
comparison only. Any choice and deal of leaves keeps all pairs; it affects speed only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, product
from math import comb, floor
from zlib import crc32

import ahocorasick  # the pyahocorasick distribution
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.session import cut, release

#: Width of a number's cell, in tolerances, and the offset that keeps round numbers off its edges.
CELL_TOLERANCES, CELL_OFFSET = 64, 0.37
#: Leaves a passage is made of at most.
PASSAGE_LEAVES = 8
#: Evaluation passages in one automaton, and training texts that one task scans with it.
SHARD_PASSAGES, SLICE_TEXTS = 120_000, 100_000
#: Pairs of classes one passage may make before it is searched again with parts of the others.
HOT_PAIRS = 1_000_000
#: Rows of coded records, or a few more, that are handed on at once.
BATCH_ROWS = 50_000
#: Letters of a leaf's code.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Between the members of a joined list; the path of a text that is one value.
SEP, ROOT = "\x1d", "$"

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?")


def leaf_values(text: str | None) -> dict[str, str] | None:
    """Path -> normalised value of the leaves that aren't null: 'n' and a number, or 't' and folded text.

    Text that isn't JSON is a single leaf; null and blank text have no leaves.
    """
    if text is None or not text.strip():
        return None
    try:
        root = json.loads(text)
    except ValueError:
        root = text
    out: dict[str, str] = {}
    stack = [("", root)]  # paths are made of keys, joined by dots
    while stack:
        path, v = stack.pop()
        if v is None:
            continue
        if isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(f"{path}.{i}", x) for i, x in enumerate(v)]
        elif isinstance(v, bool):
            out[path] = "ttrue" if v else "tfalse"
        elif isinstance(v, (int, float)):
            out[path] = f"n{float(v)!r}" if abs(v) < 1e300 else f"t{v}"
        else:
            s = v.strip()
            out[path] = f"n{float(s)!r}" if s and (s[-1].isdigit() or s[-1] == ".") and _NUMBER.fullmatch(s) and abs(float(s)) < 1e300 else "t" + s.lower()
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        paths, vals = [], []
        for text in b.pop("text"):
            x = leaf_values(text)
            ps = sorted(x) if x else []
            # joined lists: one string each, and the paths of one layout are one dictionary entry on disk
            paths.append(None if x is None else SEP.join(p or ROOT for p in ps))
            vals.append(None if x is None else SEP.join([x[p].replace(SEP, " ") for p in ps]))
        yield b.assign(paths=paths, vals=vals)


def _deal(paths: list[tuple[str, int]], blocks: int) -> list[list[str]]:
    """Paths dealt to blocks, the most varied first and to and fro; a block keeps that order."""
    out: list[list[str]] = [[] for _ in range(blocks)]
    for i, (p, _) in enumerate(sorted(paths, key=lambda x: (-x[1], x[0]))):
        turn, k = divmod(i, blocks)
        out[k if turn % 2 == 0 else blocks - 1 - k].append(p)
    return out


class Coder:
    """Writes records as codes of leaves, passage by passage."""

    def __init__(self, deal: list[list[str]], tolerance: float) -> None:
        self.deal, self.width = deal, CELL_TOLERANCES * tolerance
        self.reach = tolerance * 1.0001 / self.width
        self.layouts: dict[str, list[list[int]]] = {}  # layout -> per passage the positions of its leaves, -1 for absent ones
        self.codes: dict[str, str] = {}
        at = [0]
        for block in deal:
            at.append(at[-1] + len(block))
        self.span = list(zip(at, at[1:]))  # the leaves of a passage, in the order of the text

    def code(self, v: str) -> str:
        if (c := self.codes.get(v)) is None:
            if len(self.codes) > 500_000:
                self.codes.clear()
            h = crc32(v.encode("utf-8", "surrogatepass"))
            c = self.codes[v] = LETTERS[h & 63] + LETTERS[h >> 6 & 63]
        return c

    def leaf(self, v: str | None, train: bool) -> tuple[str, ...]:
        """The codes of a leaf: one, or two if an evaluation number lies near the edge of a cell."""
        if v is None or v[:1] != "n":
            return (self.code(v or ""),)
        x = float(v[1:]) / self.width + CELL_OFFSET
        if train:
            return (self.code(str(floor(x))),)
        a, b = floor(x - self.reach), floor(x + self.reach)
        return (self.code(str(a)),) if a == b else (self.code(str(a)), self.code(str(b)))

    def leaves(self, paths: str, vals: str, train: bool) -> list[list[tuple[str, ...]]]:
        """Per passage the codes of its leaves."""
        if (at := self.layouts.get(paths)) is None:
            pos = {p: i for i, p in enumerate(paths.split(SEP))} if paths else {}
            at = self.layouts[paths] = [[pos.get(p, -1) for p in block] for block in self.deal]
        v = vals.split(SEP)
        return [[self.leaf(v[i] if i >= 0 else None, train) for i in block] for block in at]

    def passages(self, paths: str, vals: str, train: bool) -> list[tuple[int, str]]:
        """(number, text) of a record's passages, in every spelling."""
        return [(k, f"{k}:{''.join(c)}") for k, block in enumerate(self.leaves(paths, vals, train)) for c in product(*block)]

    def with_parts(self, hot: list[tuple[int, int]], paths: str, vals: str, train: bool) -> list[tuple[int, str]]:
        """(number of the first, text) of every choice of hot passages joined to parts of the others; ``hot``: (number, hash) of a record's."""
        leaves, of = self.leaves(paths, vals, train), {}
        for k, h in sorted(hot):
            of.setdefault(k, []).append(h)
        out = []
        for m in range(1, len(of) + 1):
            for ks in combinations(of, m):
                parts = [[b[i :: m + 1] for i in range(m + 1)] for j, b in enumerate(leaves) if j not in ks]
                names = ["".join(f"{h}." for h in hs) for hs in product(*[of[k] for k in ks])]
                for sides in product(range(m + 1), repeat=len(parts)):
                    texts = ["".join(c) for c in product(*[leaf for part, side in zip(parts, sides) for leaf in part[side]])]
                    out += [(ks[0], f"{_hash(name + '.'.join(map(str, sides)))}:{t}") for name in names for t in texts]
        return out


def searches(passages: int, hot: int) -> int:
    """How often a record with ``hot`` of its ``passages`` hot is written by ``with_parts``, in one spelling."""
    return sum(comb(hot, m) * (m + 1) ** (passages - m) for m in range(1, hot + 1))


def _hash(passage: str) -> int:
    return int.from_bytes(blake2b(passage.encode(), digest_size=8).digest(), "big", signed=True)


CODED = "key binary, train boolean, start int, end int, h long, text string, shards array<int>"


def _coded(deal: list[list[str]], tolerance: float, shards: int, again: bool = False):
    """Rows of CODED: a training record's whole text and the shards it goes to, an evaluation record's passages and the shard of each.

    ``again``: rows come with the first leaves and the hashes of their hot passages, to be joined to parts of the others; each shard
    gets the training record's joined passages that fall in it.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        x = pd.DataFrame(rows, columns=["key", "train", "start", "end", "h", "text", "shards"])
        return x.astype({"start": "Int32", "end": "Int32", "h": "Int64"})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(deal, tolerance)
        of_start = {a: k for k, (a, _) in enumerate(coder.span)}
        for b in batches:
            out = []
            asked = zip(b["starts"], b["hashes"]) if again else [()] * len(b)
            for key, train, paths, vals, hot in zip(b["key"], b["train"], b["paths"], b["vals"], asked):
                ps = coder.with_parts([(of_start[s], h) for s, h in zip(*hot)], paths, vals, train) if again else coder.passages(paths, vals, train)
                if not train:
                    out += [(key, False, *coder.span[k], _hash(t), t, [_hash(t) % shards]) for k, t in ps]
                elif again:
                    of_shard: dict[int, list[str]] = {}
                    for _, t in ps:
                        of_shard.setdefault(_hash(t) % shards, []).append(t)
                    out += [(key, True, None, None, None, "".join(ts), [shard]) for shard, ts in of_shard.items()]
                else:
                    out.append((key, True, None, None, None, "".join(t for _, t in ps), sorted({_hash(t) % shards for _, t in ps})))
                if len(out) > BATCH_ROWS:
                    yield frame(out)
                    out = []
            yield frame(out)

    return build


def _scan(_key: tuple, train: pd.DataFrame, evaluation: pd.DataFrame) -> pd.DataFrame:
    """Where passages of one shard stand in whole training texts: class of the text, hash and leaves of the passage."""
    out: set[tuple] = set()
    if len(train) and len(evaluation):
        a = ahocorasick.Automaton()
        for h, s, e, p in zip(evaluation["h"], evaluation["start"], evaluation["end"], evaluation["passage"]):
            a.add_word(p, (h, s, e))
        a.make_automaton()
        for key, t in zip(train["key"], train["text"]):
            out.update((bytes(key), *x) for _, x in a.iter(t))
    got = pd.DataFrame(sorted(out), columns=["train_class", "h", "start", "end"])
    return got.astype({"h": "int64", "start": "int32", "end": "int32"})


def scan_texts(coded: DataFrame) -> DataFrame:
    """train_class, h, start, end: the evaluation passages that stand in training texts.

    The texts of a shard are cut into slices by their number, so no task scans more than SLICE_TEXTS or so of them, however many
    share a passage; the shard's distinct passages go to each slice.
    """
    texts = coded.where("train").select("key", "text", F.explode("shards").alias("shard"))
    slices = texts.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_TEXTS)).cast("int").alias("slices"))  # a row per shard
    texts = texts.join(slices, "shard").select("shard", F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slice"), "key", "text")
    passages = coded.where("not train").select(F.col("shards")[0].alias("shard"), "h", "start", "end", F.col("text").alias("passage")).distinct()
    passages = passages.join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "h", "start", "end", "passage")
    found = texts.groupBy("shard", "slice").cogroup(passages.groupBy("shard", "slice")).applyInPandas(_scan, "train_class binary, h long, start int, end int")
    return found.distinct()


def merged_length(intervals: Column) -> Column:
    """Leaves covered by an array of (start, end) intervals, which may overlap."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    grown = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["at"], x["start"]))).alias("n"), F.greatest(a["at"], x["end"]).alias("at"))
    return F.aggregate(F.array_sort(intervals), none, grown, lambda a: a["n"])


def near_same_records(
    df: DataFrame, record_id: str, text: Column, is_train: Column, max_diff: int = 3, tolerance: float = 0.001
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, coverage).

    pairs: train_class, eval_class, differing, covered; every pair of a training and an evaluation record of which at
    most ``max_diff`` leaf values differ, once per pair of classes of records with the same leaves. members: class,
    record id, is_train. coverage: class, covered, for classes of evaluation records of which any training text holds a
    passage. Numbers, also those written as text, are equal up to ``tolerance``; texts but for case and
    outer spaces; a missing leaf equals null. ``covered`` is the share of the leaves in passages that merged intervals
    cover, in the pair's training text or in any. Records with a null id or a null ``is_train`` and those with null or
    blank text match nothing; one without any leaf (``{}``) matches those of at most ``max_diff`` leaves. Text that isn't
    JSON is one leaf. Ids must be unique; other columns are ignored. An empty table gives none.
    """
    rows = df.select(F.col(record_id).alias("id"), is_train.alias("train"), text.alias("text")).where("id is not null and train is not null")
    parsed = rows.mapInPandas(_parse, f"id {dict(rows.dtypes)['id']}, train boolean, paths string, vals string").where("paths is not null")
    # a class is all records of the same leaves; its name is their digest
    parsed = cut(parsed.withColumn("key", F.unhex(F.md5(F.concat_ws("\x1e", "paths", "vals")))))
    members = parsed.select(F.col("key").alias("class"), F.col("id").alias(record_id), "train")
    per_place = parsed.where("paths <> ''").select("paths", F.posexplode(F.split("vals", SEP))).groupBy("paths", "pos").agg(F.approx_count_distinct("col", 0.05).alias("n"))
    per_path = per_place.groupBy(F.element_at(F.split("paths", SEP), F.col("pos") + 1).alias("path")).agg(F.sum("n").alias("n"))
    # a leaf that is the same everywhere tells no records apart
    most = PASSAGE_LEAVES * (max_diff + 1)
    deal = _deal([(r[0], r[1]) for r in per_path.where("n > 1").orderBy(F.desc("n"), "path").limit(most).collect()], max_diff + 1)
    total = max(1, sum(map(len, deal)))

    shards_for = lambda passages: max(1, -(-passages // SHARD_PASSAGES))
    shards = shards_for(parsed.where("not train").count() * (max_diff + 1))
    coded = cut(parsed.select("key", "train", "paths", "vals").mapInPandas(_coded(deal, tolerance, shards), CODED))
    hits = cut(scan_texts(coded))
    # only passages that some training text holds make candidates
    asked = cut(coded.where("not train").select("h", "start", "end", F.col("key").alias("eval_class")).join(hits.select("h"), "h", "left_semi").distinct())
    release(coded)
    span = F.struct("start", "end")
    coverage = asked.groupBy(F.col("eval_class").alias("class")).agg((merged_length(F.collect_set(span)) / F.lit(total)).alias("covered"))

    many = hits.groupBy("h").agg(F.count(F.lit(1)).alias("t")).join(asked.groupBy("h").agg(F.count(F.lit(1)).alias("e")), "h")
    hot = cut(many.where(F.col("t") * F.col("e") > HOT_PAIRS).select("h"))
    cold = lambda x: x.join(hot, "h", "left_anti")
    held = lambda x, c: x.join(hot, "h", "left_semi").groupBy(c).agg(F.collect_set(F.struct("h", "start", "end")).alias("hot"))
    shared = cold(hits).select("train_class", "h", "start", "end").join(cold(asked).select("eval_class", "h"), "h").select("train_class", "eval_class", "start", "end")
    if any_hot := bool(hot.take(1)):
        sides = [held(x, c).select(F.col(c).alias("key"), F.lit(c == "train_class").alias("train"), F.col("hot.start").alias("starts"), F.col("hot.h").alias("hashes")) for x, c in ((hits, "train_class"), (asked, "eval_class"))]
        one = parsed.select("key", "train", "paths", "vals").dropDuplicates(["key", "train"])
        again = cut(one.join(sides[0].unionByName(sides[1]), ["key", "train"]))
        sizes = again.where("not train").groupBy(F.least(F.size("starts"), F.lit(max_diff + 1)).alias("n")).count().collect()
        shards = shards_for(sum(r["count"] * searches(max_diff + 1, r["n"]) for r in sizes))
        coded = cut(again.select("key", "train", "paths", "vals", "starts", "hashes").mapInPandas(_coded(deal, tolerance, shards, True), CODED))
        refined = scan_texts(coded).join(coded.where("not train").select("h", F.col("key").alias("eval_class")).distinct(), "h")
        shared = shared.unionByName(refined.select("train_class", "eval_class", "start", "end"))
    pairs = cut(shared.groupBy("train_class", "eval_class").agg(F.collect_set(span).alias("spans")))

    suspects = pairs.select(F.col("train_class").alias("key")).unionByName(pairs.select(F.col("eval_class").alias("key"))).distinct()
    # the wide rows move once, to the keys of the pairs; any record of a class stands for it
    texts_of = cut(parsed.select("key", "paths", "vals").join(suspects, "key", "left_semi").dropDuplicates(["key"]))
    leaves = F.expr(f"case when paths = '' then map() else map_from_arrays(split(paths, '{SEP}'), split(vals, '{SEP}')) end")
    of = lambda c, m: texts_of.select(F.col("key").alias(c), leaves.alias(m))
    both = pairs.join(of("train_class", "a"), "train_class").join(of("eval_class", "b"), "eval_class")
    number = "(a[p] like 'n%' and b[p] like 'n%' and abs(cast(substring(a[p], 2) as double) - cast(substring(b[p], 2) as double)) <= " + repr(tolerance * (1 + 1e-6)) + ")"
    differing = F.expr(f"size(filter(array_union(map_keys(a), map_keys(b)), p -> not (a[p] <=> b[p]) and not coalesce({number}, false)))")
    near = both.withColumn("differing", differing).where(F.col("differing") <= max_diff).select("train_class", "eval_class", "differing", "spans")
    if any_hot:  # a pair also covers the hot passages that it shares
        near = near.join(held(hits, "train_class").withColumnRenamed("hot", "x"), "train_class", "left").join(held(asked, "eval_class").withColumnRenamed("hot", "y"), "eval_class", "left")
        near = near.withColumn("spans", F.expr("array_union(spans, coalesce(transform(array_intersect(x, y), s -> named_struct('start', s.start, 'end', s.end)), array()))"))
    near = near.select("train_class", "eval_class", "differing", (merged_length(F.col("spans")) / F.lit(total)).alias("covered"))
    return near, members, coverage
