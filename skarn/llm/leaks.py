"""Evaluation passages leaking into a training corpus.

A passage is a run of ``n_words`` consecutive words of an item. If a document holds a passage of m characters with at
most k edits, the two share at least m + 1 - q (k + 1) q-grams (q-gram lemma), and those lie on k + 1 neighbouring
diagonals (document position minus item position). So per document and item the shared q-grams are counted in
overlapping diagonal bands; a band goes on only if some passage reaches its bound there, and is then verified by a
banded alignment of the passage with the region. A batch of documents is searched as one text, with gaps no match can cross.

The items are the stated query set; they are read in blocks of bounded size, and a block's q-gram index travels with
the tasks that scan the documents. The documents are neither shuffled nor joined, so no key can be hot. The corpus is read
once: with several blocks, that pass keeps the documents that hold enough q-grams of any item close together (a necessary
condition, tested with a bit table over all items), and the blocks are then matched with these documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import COMMENT_MARK, INVISIBLE, TAG
from skarn.session import cut

#: Length of a q-gram and width of a band of diagonals.
Q, BAND = 12, 8
#: Characters of items in one block, and of documents handled at once.
BLOCK_CHARS, CHUNK_CHARS = 1_000_000, 1_000_000
#: Bits of the table that most of a text's q-grams are dismissed by, of one block and, at most, of all items; bits an item's character has in the latter.
SIEVE_BITS, SIEVE_MOST_BITS, BITS_A_CHARACTER = 22, 31, 16
#: What stands between the documents of a batch.
GAP = "\x00"


def padded(texts: pa.Array) -> pa.Array:
    """The texts' words, in lower case, with a space before, between and after; empty without any. Null counts as empty.

    Words are runs of letters and digits, after marks of comments, tags and invisible characters are dropped.
    """
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    for p in (COMMENT_MARK, TAG, INVISIBLE):
        t = pc.replace_substring_regex(t, p.pattern, "")
    t = pc.replace_substring_regex(pc.utf8_lower(t), r"[^\p{L}\p{N}]+", " ")
    t = pc.utf8_trim(t, " ")
    none, space = pa.scalar("", t.type), pa.scalar(" ", t.type)
    return pc.if_else(pc.equal(t, none), none, pc.binary_join_element_wise(space, t, space, none))


def _padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), padded(b.column(1)).cast(pa.string())], ["item", "text"])


def gram_hashes(s: str, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of ``s``."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[i : i + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def banded_edits(passage: str, region: str, most: int, offset: int) -> int:
    """The least edits between ``passage`` and a part of ``region`` that begins near ``offset``; most + 1 if more.

    Only cells within ``BAND`` + 2 ``most`` diagonals of the offset are computed.
    """
    if passage in region:
        return 0
    half = BAND + 2 * most
    far = most + 1
    lo, hi = max(0, offset - half), min(len(region), offset + half)
    row = {j: 0 for j in range(lo, hi + 1)}  # a match may begin anywhere in the band
    for i, c in enumerate(passage, 1):
        lo, hi = max(0, i + offset - half), min(len(region), i + offset + half)
        new: dict[int, int] = {}
        for j in range(lo, hi + 1):
            best = row.get(j, far) + 1
            if j > 0:
                best = min(best, row.get(j - 1, far) + (region[j - 1] != c), new.get(j - 1, far) + 1)
            new[j] = min(best, far)
        row = new
        if min(row.values(), default=far) >= far:
            return far
    return min(row.values(), default=far)


def passage_spans(s: str, n_words: int) -> np.ndarray:
    """(begin, end) of every passage of a padded text, with the spaces around it."""
    at = [i for i, c in enumerate(s) if c == " "]
    return np.array([(at[i], at[i + n_words] + 1) for i in range(len(at) - n_words)], np.int64).reshape(-1, 2)


def passage_bounds(spans: np.ndarray, q: int, edits: int) -> np.ndarray:
    """q-grams that a passage and its match share at least."""
    return np.maximum(1, spans[:, 1] - spans[:, 0] + 1 - q * (edits + 1))


class PassageIndex:
    """q-grams and passages of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n_words: int, edits: int, q: int) -> None:
        self.edits, self.q = edits, q
        self.ids, self.texts, self.spans = [], [], []
        for item, s in items:
            spans = passage_spans(s, n_words)
            if len(spans):
                self.ids.append(item)
                self.texts.append(s)
                self.spans.append(spans)
        h = [gram_hashes(s, self.q) for s in self.texts]
        self.hash = np.concatenate([*h, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        self.at = np.concatenate([*(np.arange(len(x)) for x in h), np.zeros(0, np.int64)]).astype(np.int64)
        o = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[o], self.item[o], self.at[o]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.hash >> np.uint64(64 - SIEVE_BITS)] = True
        self.bound = [passage_bounds(x, q, edits) for x in self.spans]
        self.least = np.array([b.min() for b in self.bound], np.int64)
        self.longest = max((int((x[:, 1] - x[:, 0]).max()) for x in self.spans), default=0)

    def regions(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """(position of the item, first diagonal of the band, item positions shared in the band) where a bound may be met."""
        h = gram_hashes(text, self.q)
        pos = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE_BITS)])
        lo, hi = np.searchsorted(self.hash, h[pos], "left"), np.searchsorted(self.hash, h[pos], "right")
        n = hi - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        if not len(pos):
            return
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(lo, n)
        item, at = self.item[k], self.at[k]
        diagonal = np.repeat(pos, n) - at + (1 << 32)
        band = diagonal // BAND
        also = diagonal % BAND < self.edits  # bands overlap by the edits, so a match lies wholly in one
        key = np.r_[(item << 40) + band, (item[also] << 40) + band[also] - 1]
        at = np.r_[at, at[also]]
        o = np.argsort(key, kind="stable")
        key, at = key[o], at[o]
        cut_at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut_at, len(key)])
        for c, m in zip(cut_at[size >= self.least[key[cut_at] >> 40]], size[size >= self.least[key[cut_at] >> 40]]):
            yield int(key[c] >> 40), int((key[c] & ((1 << 40) - 1)) * BAND - (1 << 32)), np.unique(at[c : c + m])

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item's number, passage's number, edits, where its match begins, give or take a band) of every passage found."""
        for i, diagonal, at in self.regions(text):
            s, e = self.spans[i][:, 0], self.spans[i][:, 1]
            shared = np.searchsorted(at, e - self.q, "right") - np.searchsorted(at, s, "left")
            for w in np.flatnonzero(shared >= self.bound[i]):
                a, b = int(s[w]), int(e[w])
                lo = max(0, a + diagonal - self.edits)
                region = text[lo : b + diagonal + BAND + 2 * self.edits]
                d = banded_edits(self.texts[i][a:b], region, self.edits, a + diagonal - lo)
                if d <= self.edits:
                    yield i, int(w), d, a + diagonal


def batches_of(texts: list[str], overlap: int, gap: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, places, numbers): texts joined by gaps into pieces of at most CHUNK_CHARS or so; a place is where a text begins.

    A longer text comes in parts that overlap, each under the text's number.
    """
    sep = GAP * gap
    held: list[str] = []
    at: list[int] = []
    of: list[int] = []
    size = 0
    step = max(CHUNK_CHARS, 4 * overlap)
    for k, s in enumerate(texts):
        for start in range(0, len(s), step):
            part = s[start : start + step + overlap]
            if held and size + len(part) > step:
                yield sep.join(held), np.array(at), np.array(of)
                held, at, of, size = [], [], [], 0
            held.append(part)
            at.append(size)
            of.append(k)
            size += len(part) + gap
    if held:
        yield sep.join(held), np.array(at), np.array(of)


def _scan(items: list[tuple[int, str]], n_words: int, edits: int, q: int, ready: bool):
    """Batches of (doc, text) to (doc, item, edits, passages); ``ready``: texts are padded already."""
    gap = 2 * (BAND + 2 * edits) + 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PassageIndex(items, n_words, edits, q)
        for b in batches:
            texts = (b.column(1) if ready else padded(b.column(1))).to_pylist()
            found: dict[tuple[int, int], dict[int, int]] = {}
            for text, places, of in batches_of(texts, index.longest + 2 * edits, gap):
                for i, w, d, at in index.matches(text):
                    doc = int(of[max(0, np.searchsorted(places - gap // 2, at, "right") - 1)])
                    got = found.setdefault((doc, i), {})
                    got[w] = min(d, got.get(w, d))
            if found:
                rows = [(doc, index.ids[i], m := min(got.values()), sum(x == m for x in got.values())) for (doc, i), got in sorted(found.items())]
                doc, item, d, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(n, pa.int32())], ["doc", "item", "edits", "passages"])

    return scan


def _sieve(bits: np.ndarray, q: int, width: int, least: int):
    """Batches of (doc, text) to (doc, padded text) of those in which ``least`` q-grams of ``width`` neighbouring ones pass the bit table."""
    shift = np.uint64(64 - (len(bits) * 8 - 1).bit_length())

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = padded(b.column(1))
            keep: set[int] = set()
            for text, places, of in batches_of(texts.to_pylist(), width + q, q):
                at = gram_hashes(text, q) >> shift
                run = np.r_[0, np.cumsum(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)]
                dense = np.flatnonzero(run[width:] - run[:-width] >= least) if len(run) > width else np.flatnonzero(run[-1:] >= least)
                # a dense stretch may begin in the text before
                for side in (dense, dense + width - 1):
                    keep.update(of[np.searchsorted(places, side, "right") - 1].tolist())
            rows = pa.array(sorted(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), texts.take(rows).cast(pa.string())], ["doc", "text"])

    return sieve


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n_words: int = 10, edits: int = 1) -> DataFrame:
    """doc_id, item_id, edits, passages: every document that holds a passage of an item with at most ``edits`` edits.

    A passage is ``n_words`` consecutive words of the item; words are runs of letters and digits in lower case, after
    markup tags and invisible characters are dropped. ``edits`` is the least number of character edits of a passage
    found (0: the words stand there as they are, word for word), ``passages`` how many of the item's were found with that many.
    Null, blank and shorter texts hold and give no passages. Repeated rows of a document count each; ids should be
    unique. Empty tables give no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    asked = cut(asked.mapInArrow(_padded, "item long, text string")).orderBy("item")
    schema = f"doc {dict(rows.dtypes)['doc']}, item long, edits int, passages int"

    def blocks() -> Iterator[list[tuple[int, str]]]:  # the driver holds one at a time
        held: list[tuple[int, str]] = []
        chars = 0
        for r in asked.toLocalIterator():
            s = r[1]
            if held and chars + len(s) > BLOCK_CHARS:
                yield held
                held, chars = [], 0
            held.append((r[0], s))
            chars += len(s)
        yield held

    shortest, longest, chars, count = Q * (edits + 1), 0, 0, 0
    for block in blocks():
        count += 1
        for _, s in block:
            x = passage_spans(s, n_words)
            if len(x):
                n = x[:, 1] - x[:, 0]
                shortest, longest, chars = min(shortest, int(n.min())), max(longest, int(n.max())), chars + len(s)
    # a shorter q keeps the bound of the shortest passage at one q-gram or more
    q = max(1, min(Q, shortest // (edits + 1)))
    finish = lambda x: x.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "edits", "passages")
    if count == 1:
        return finish(rows.mapInArrow(_scan(next(blocks()), n_words, edits, q, False), schema))
    bits = np.zeros((1 << min(max((BITS_A_CHARACTER * chars).bit_length(), SIEVE_BITS), SIEVE_MOST_BITS)) // 8, np.uint8)
    shift = np.uint64(64 - (len(bits) * 8 - 1).bit_length())
    least = Q * longest
    for block in blocks():
        for _, s in block:
            x = passage_spans(s, n_words)
            if len(x):
                at = gram_hashes(s, q) >> shift
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                least = min(least, int(passage_bounds(x, q, edits).min()))
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** (SIEVE_MOST_BITS - 3) bytes at most

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sieve(sent.value, q, longest + edits, least)(batches)

    likely = cut(rows.mapInArrow(sieve, f"doc {dict(rows.dtypes)['doc']}, text string"))
    found: DataFrame | None = None
    for block in blocks():
        hit = cut(likely.mapInArrow(_scan(block, n_words, edits, q, True), schema))
        found = hit if found is None else found.unionByName(hit)
    return finish(found)
