"""Abusive, hateful or sexually explicit language.

A text is undisguised (tags, invisible characters, look-alike letters, digits and signs for letters, spread letters,
stretched vowels, starred-out words) and read as words; a window is a run of at most WINDOW words of one sentence. Its
sparse features are its words, pairs of neighbouring words and of words one apart, hashed, and the word classes these
belong to, alone and in such pairs. A cumulative-link (ordinal logistic) model with one weight vector shared by ordered
thresholds gives P(grade >= 1, 2, 3); a document has the expected severity of its worst window, 0 to 3, and is flagged
if P(grade >= 1) of that window reaches FLAG_AT. A window's score is a sum over its words and pairs, so a batch of
documents is scored at once from running sums, without a loop over windows.

The model is trained here, on reviewers' verdicts and on a short list of graded examples. A verdict says only whether a
document is abusive: 'no' grades its worst window 0 and 'yes' says grade >= 1 for it, and which window is the worst is
found anew in every round (at first by the odds of its features between documents judged 'yes' and 'no'). A few verdicts
are wrong: those that a model fitted on the other half of the verdicts contradicts don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.abuse_words import CLASSES, EXAMPLES
from skarn.llm.text import COMMENT_MARK, INVISIBLE, TAG, plain

#: Most verdicts the model is fitted on, and most characters of their texts: a bounded sample, by a hash of the document id.
MAX_VERDICTS, MAX_VERDICT_CHARS = 8_000, 16_000_000
#: Probability of grade 1 or more at which a document is flagged; below one half, since reviewers read what is flagged.
FLAG_AT = 0.3
#: Words in a window; number of grades above 0; rounds in which worst windows are chosen anew.
WINDOW, GRADES, ROUNDS = 8, 3, 8
#: A 'yes' verdict counts only if a model fitted on the other half finds the document worse than this share of those judged
#: 'no'; a 'no' verdict only if that model's probability stays under the limit.
DOUBT_YES, DOUBT_NO, DOUBT_ROUNDS = 0.8, 0.9, 4
#: A majority of so many verdicts on a text is never doubted.
CLEAR = 3
#: Buckets of the feature hash.
BUCKETS = 1 << 18

#: Cyrillic and Greek letters that look like Latin ones, and signs used for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏԛԝвнкмтαορνικτυ", "aeopcyxijsdhlqwbhkmtaopviktu")
SIGNS = str.maketrans("0134578@$!€", "oieastbasie")

_SPREAD = re.compile(r"(?<![^\W_])[a-z@$*0-9]([ .\-_])[a-z@$*0-9!](?![\w@$*])(?:\1[a-z@$*0-9!](?![\w@$*]))+")
_BOLD = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^*]+?)(?<=[^\s*])\*\*(?![\w*])")
#: Expressions of the vectorised path (RE2): texts that need the two above or look-alike letters, ends of sentences (written as END_MARK), what lies between words.
_SUSPECT = r"\*\*|[\p{Cyrillic}\p{Greek}]|(?:^|[^a-z0-9])[a-z@$*0-9][ .\-_][a-z@$*0-9!][ .\-_][a-z@$*0-9!](?:[^a-z0-9]|$)"
_ENDS, _BETWEEN, END_MARK = r"[\n\r“”\"{}]+|[.;?!]+(?:\s|$)", r"[^a-z0-9@$!*€'\x01]+", "\x01"
#: Characters of texts read at a time.
READ_CHARS = 16_000_000
_LETTER = re.compile(r"[a-z]")
#: Classes whose words may end in a plural s.
_NOUNS = {"insult", "dehumanise", "group"}
#: What a token can be besides a word: nothing, and an end of a sentence.
NOTHING, END = -1, -2


def _word_classes(classes: dict[str, str]) -> dict[str, tuple[str, ...]]:
    out: dict[str, list[str]] = {}
    for name, ws in classes.items():
        for w in ws.split():
            if name not in out.setdefault(plain(w), []):
                out[plain(w)].append(name)
    return {w: tuple(c) for w, c in out.items()}


def _mix(x: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit keys."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Words:
    """A batch of texts as words: owner (text), sentence, hash and class pattern of every word, in order."""

    owner: np.ndarray
    sentence: np.ndarray
    hash: np.ndarray
    pattern: np.ndarray


@dataclass
class Reader:
    """Turns texts into words."""

    classes: dict[str, tuple[str, ...]]
    #: Token -> hash of its word (or NOTHING, END) and its class pattern.
    tokens: dict[str, tuple[int, int]] = field(default_factory=dict)
    by_length: dict[int, list[str]] = field(default_factory=dict)
    kinds: dict[tuple[str, ...], int] = field(default_factory=dict)

    @classmethod
    def of(cls, classes: dict[str, str]) -> Reader:
        r = cls(_word_classes(classes))
        for w in r.classes:
            r.by_length.setdefault(len(w), []).append(w)
        r.kinds = {c: i for i, c in enumerate(sorted({(), *r.classes.values()}))}
        return r

    def known(self, w: str) -> str | None:
        """The listed form of a word: itself, or a noun without its plural s."""
        if w in self.classes:
            return w
        return b if w.endswith("s") and len(w) > 3 and _NOUNS & set(self.classes.get(b := w[:-1], ())) else None

    def word(self, t: str) -> str:
        """The plain form of a token; '#' for a number."""
        t = t.strip("!'")
        if t.isdigit():
            return "#"
        if "*" in t and (not t[:1].isalnum() or t.strip("*").isalnum() and t.count("*") < 2):
            t = t.strip("*")
        if not _LETTER.search(t) and ("@" not in t and "$" not in t or len(t) < 4 or t[1:2].isdigit()):
            return "#" if t.strip("*$€@!") else ""
        if "*" in t:
            return self._starred(t)
        if "'" in t:
            return t.replace("'", "")
        forms = [t] if t.isalpha() else [t.translate(SIGNS), t.replace("1", "l").translate(SIGNS)]
        for f in list(forms):
            forms += [re.sub(r"(.)\1{2,}", r"\1", f), re.sub(r"(.)\1{2,}", r"\1\1", f)]
        for f in forms:
            if k := self.known(f):
                return k
        return forms[0] if t.isalpha() or t[0] != "$" and not t[0].isdigit() else t

    def _starred(self, t: str) -> str:
        """A listed word that the visible letters of a starred-out one fit, or '<stars>'."""
        for end in ("", "s"):
            if t.endswith(end):
                n = len(t) - len(end)
                p = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in t[:n].translate(SIGNS)))
                fits = [w for w in self.by_length.get(n, []) if p.fullmatch(w)]
                for name in ("insult", "dehumanise", "sex", "swear", "scorn", "violence"):
                    for w in fits:
                        if name in self.classes[w]:
                            return w
        return "<stars>"

    def _joined(self, m: re.Match) -> str:
        """Spread letters as a word, if they make a listed one; a leading 'a' or 'i' may be a word of its own."""
        w = m[0].replace(m[1], "")
        for cut in (0, 1):
            if self.known(f := self.word(w[cut:])):
                return f"{w[:cut]} {f}"
        return m[0] if m[1] == " " or sum(c.isdigit() for c in w) > 2 else w

    def _suspect(self, text: str) -> str:
        """A lower-case text without look-alike letters, bold marks and spread letters."""
        return _SPREAD.sub(self._joined, _BOLD.sub(r"\1", text.translate(LOOKALIKES)))

    def clean(self, texts: pa.Array) -> pa.Array:
        """Lower case without accents and the disguises that don't depend on the word; ends of sentences marked."""
        t = pc.fill_null(texts, "")
        t = pc.replace_substring_regex(pc.utf8_normalize(t, "NFKD"), r"\p{Mn}", "")
        for p in (COMMENT_MARK, INVISIBLE, TAG):
            t = pc.replace_substring_regex(t, p.pattern, "")
        t = pc.replace_substring(pc.replace_substring(pc.utf8_lower(t), "ß", "ss"), "’", "'")
        odd = np.flatnonzero(pc.match_substring_regex(t, _SUSPECT).to_numpy(zero_copy_only=False))
        if len(odd):
            mask = np.zeros(len(t), bool)
            mask[odd] = True
            t = pc.replace_with_mask(t, pa.array(mask), pa.array([self._suspect(x) for x in t.take(pa.array(odd)).to_pylist()], t.type))
        return pc.replace_substring_regex(t, _ENDS, f" {END_MARK} ")

    def _token(self, t: str) -> tuple[int, int]:
        w = "" if t == END_MARK else self.word(t)
        out = self.tokens[t] = (END if t == END_MARK else 1 + crc32(w.encode()) if w else NOTHING, self.kinds[self.classes.get(w, ())])
        return out

    def read(self, texts: pa.Array) -> Words:
        """Whole texts; a text's words don't depend on the others'."""
        if len(self.tokens) > 500_000:
            self.tokens = {}
        parts = pc.split_pattern_regex(self.clean(texts), _BETWEEN)
        owner = pc.list_parent_indices(parts).to_numpy()
        codes = pc.list_flatten(parts).dictionary_encode()
        get, new = self.tokens.get, self._token
        known = np.array([get(t) or new(t) for t in codes.dictionary.to_pylist()], np.int64).reshape(-1, 2)[codes.indices.to_numpy()]
        h = known[:, 0]
        stop = np.cumsum(h == END) + owner  # grows at every end of a sentence and at every new text
        keep = h > 0
        return Words(owner[keep], stop[keep], h[keep].astype(np.uint64), known[keep, 1])


def position_features(x: Words, kinds: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, usable, reach) of every kind of feature: a feature at place p stands on the words p and p + reach."""
    n, h, c = len(x.hash), x.hash, x.pattern.astype(np.uint64)
    out = [(_mix(h), h != np.uint64(1 + crc32(b"#")), 0), (_mix(c + np.uint64(1 << 40)), x.pattern > 0, 0)]
    for gap in (1, 2):
        ok = np.zeros(n, bool)
        a, b, ca, cb = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if n > gap:
            ok[:-gap] = x.sentence[gap:] == x.sentence[:-gap]
            a[:-gap], b[:-gap], ca[:-gap], cb[:-gap] = h[:-gap], h[gap:], c[:-gap], c[gap:]
        out.append((_mix(a * np.uint64(0x100000001B3) + b + np.uint64(gap << 42)), ok, gap))
        out.append((_mix((ca * np.uint64(kinds) + cb) * np.uint64(4) + np.uint64(gap) + np.uint64(1 << 44)), ok & (ca > 0) & (cb > 0), gap))
    return out


def worst_windows(x: Words, features: list[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the largest score of a window (-inf without words), and the window's first and last word's place."""
    best, first, last = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.full(texts, -1)
    n = len(x.hash)
    if not n:
        return best, first, last
    place = np.arange(n)
    new = np.r_[True, x.sentence[1:] != x.sentence[:-1]]
    begin = np.maximum.accumulate(np.where(new, place, 0))  # of the word's sentence
    start = np.maximum(begin, place - WINDOW + 1)  # the window that ends at a place
    score = np.zeros(n)
    for bucket, ok, gap in features:
        run = np.r_[0.0, np.cumsum(np.where(ok, weights[bucket], 0.0))]
        score += run[np.maximum(place - gap + 1, start)] - run[start]
    head = np.flatnonzero(np.r_[True, x.owner[1:] != x.owner[:-1]])
    most = np.repeat(np.maximum.reduceat(score, head), np.diff(np.r_[head, n]))
    top = np.flatnonzero(score == most)
    top = top[np.r_[True, x.owner[top][1:] != x.owner[top][:-1]]]
    own = x.owner[top]
    best[own], first[own], last[own] = score[top], start[top], top
    return best, first, last


def window_rows(features: list[tuple[np.ndarray, np.ndarray, int]], first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The buckets of windows given by their first and last places."""
    return [np.concatenate([b[s : max(s, e + 1 - gap)][ok[s : max(s, e + 1 - gap)]] for b, ok, gap in features]) for s, e in zip(first, last)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: list[np.ndarray], low: np.ndarray, high: np.ndarray, weight: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 120, decay: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of P(grade >= k) = sigmoid(w x - theta_k), for grades known to lie in [low, high]."""
    n = np.array([len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, np.int64)])
    used, cols = np.unique(cols, return_inverse=True)  # only buckets that occur have a gradient
    owner = np.repeat(np.arange(len(rows)), n)
    w, theta = (x.copy() for x in start) if start else (np.zeros(BUCKETS), np.array([2.0, 4.0, 6.0][:GRADES]))
    full, w = w, w[used]
    vw, vt, total = np.full(len(used), 1e-10), np.full(GRADES, 1e-10), weight.sum()
    edge = np.arange(len(rows))
    for _ in range(rounds):
        s = np.bincount(owner, w[cols], len(rows))
        f = _sigmoid(s[:, None] - theta[None, :])
        f = np.hstack([np.ones((len(rows), 1)), f, np.zeros((len(rows), 1))])
        a, b = f[edge, low], f[edge, high + 1]
        p = np.maximum(a - b, 1e-9)
        gw = np.bincount(cols, (weight * (1 - a - b) / total)[owner], len(used)) - decay * w
        da, db = weight * a * (1 - a) / p / total, weight * b * (1 - b) / p / total
        gt = np.array([db[high + 1 == k].sum() - da[low == k].sum() for k in range(1, GRADES + 1)])
        vw, vt = vw + gw**2, vt + gt**2
        w += 0.1 * gw / np.sqrt(vw)
        theta = np.maximum.accumulate(theta + 0.1 * gt / np.sqrt(vt))
    full[used] = w
    return full, theta


@dataclass
class AbuseModel:
    weights: np.ndarray
    theta: np.ndarray
    classes: dict[str, str]


def settled(verdicts: list[tuple[str | None, int]]) -> list[tuple[str, int, int]]:
    """(text, verdict, majority) per text, none for a tie."""
    votes: dict[str, int] = {}
    for t, y in verdicts:
        if t:
            votes[t] = votes.get(t, 0) + (1 if y else -1)
    return sorted((t, int(v > 0), abs(v)) for t, v in votes.items() if v)


def believable(judged: list[tuple[str, int, int]], **options: object) -> list[tuple[str, int, int]]:
    """The verdicts that a model fitted on the other half of them doesn't contradict, and those of a clear majority.

    Halves are told by a hash of the text.
    """
    half = [crc32(v[0].encode("utf-8", "surrogatepass")) & 1 for v in judged]
    out = []
    for k in (0, 1):
        asked = [v for v, h in zip(judged, half) if h == k]
        if not asked:
            continue
        m = train([v[:2] for v, h in zip(judged, half) if h != k], rounds=DOUBT_ROUNDS, doubt=False, **options)
        p, y = Grader(m).grade(pa.array([v[0] for v in asked], pa.large_string()))[1], np.array([v[1] for v in asked])
        least = np.quantile(p[y == 0], DOUBT_YES) if (y == 0).any() else -1.0
        out += [v for v, x in zip(asked, p) if v[2] >= CLEAR or (x > least if v[1] else x < DOUBT_NO)]
    return out


def train(verdicts: list[tuple[str | None, int]], classes: dict[str, str] = CLASSES, examples: str = EXAMPLES, rounds: int = ROUNDS, doubt: bool = True) -> AbuseModel:
    """Fit on graded example sentences and on (text, 0 or 1) verdicts; either may be absent.

    Copies of a text count once, by the majority of their verdicts, and not at all if that is a tie. With ``doubt``
    verdicts that the others contradict are left out first.
    """
    reader = Reader.of(classes)
    kinds = len(reader.kinds)
    graded = [x.split("|", 1) for x in examples.strip().splitlines()]
    told = reader.read(pa.array([s for _, s in graded], pa.large_string()))
    f = position_features(told, kinds)
    edges = np.searchsorted(told.owner, np.arange(len(graded) + 1))
    rows = window_rows(f, edges[:-1], edges[1:] - 1)
    low = [int(g) for g, _ in graded]
    rows.append(np.zeros(0, np.int64))  # a window without anything known is ordinary
    low.append(0)
    base = np.r_[np.full(len(graded), 1.0), 20.0]
    w, theta = fit_ordinal(rows, np.array(low), np.array(low), base)
    judged = settled(verdicts)
    if doubt:
        judged = believable(judged, classes=classes, examples=examples)
    texts, yes = [v[0] for v in judged], np.array([v[1] for v in judged], bool)
    if not texts:
        return AbuseModel(w.astype(np.float32), theta, classes)
    x = reader.read(pa.array(texts, pa.large_string()))
    f = position_features(x, kinds)
    # the odds of a feature: in how many documents of either verdict it stands
    seen = np.unique(np.concatenate([x.owner[ok] * BUCKETS + b[ok] for b, ok, _ in f]))
    has, bucket = yes[seen // BUCKETS], seen % BUCKETS
    n1, n0 = np.bincount(bucket[has], minlength=BUCKETS), np.bincount(bucket[~has], minlength=BUCKETS)
    k1, k0 = max(1, yes.sum()), max(1, (~yes).sum())
    odds = np.log((n1 + 0.5) / (k1 + 1)) - np.log((n0 + 0.5) / (k0 + 1))
    odds[(n1 + n0) < 3] = 0.0
    scale = 0.35
    seen_rows: dict[tuple[int, int, int], None] = {}
    for turn in range(rounds):
        look = w + scale * odds if turn == 0 else w
        best, first, last = worst_windows(x, f, look, len(texts))
        best = np.where(np.isfinite(best), best, 0.0) - theta[0]
        # a verdict that the rest contradicts outright is taken for a wrong one
        wrong = np.where(yes, best < -2.0, best > 4.0) & (turn > 1)
        pick = np.flatnonzero(~wrong & (last >= first))
        for i in pick[~yes[pick]]:  # every window of a 'no' that ever was the worst stays ordinary
            seen_rows[(int(i), int(first[i]), int(last[i]))] = None
        bad = pick[yes[pick]]
        calm = np.array([k for k in seen_rows if not wrong[k[0]]], np.int64).reshape(-1, 3)
        more = window_rows(f, np.r_[first[bad], calm[:, 1]], np.r_[last[bad], calm[:, 2]])
        lo = np.r_[low, np.ones(len(bad)), np.zeros(len(calm))].astype(int)
        hi = np.r_[low, np.full(len(bad), GRADES), np.zeros(len(calm))].astype(int)
        wt = np.r_[base, np.full(len(bad), 1.0), np.full(len(calm), 1.0)]
        w, theta = fit_ordinal(rows + more, lo, hi, wt, (w, theta), rounds=60)
    return AbuseModel(w.astype(np.float32), theta, classes)


class Grader:
    """Scores texts with a model."""

    def __init__(self, model: AbuseModel) -> None:
        self.model, self.reader = model, Reader.of(model.classes)
        self.weights = model.weights.astype(np.float64)

    def grade(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade >= 1)) of the worst window of every text; zeros without any word."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // READ_CHARS
        best = np.full(len(texts), -np.inf)
        for part in np.unique(sizes):
            at = int(np.searchsorted(sizes, part)), int(np.searchsorted(sizes, part, "right"))
            x = self.reader.read(texts.slice(at[0], at[1] - at[0]).cast(pa.large_string()))
            best[at[0] : at[1]] = worst_windows(x, position_features(x, len(self.reader.kinds)), self.weights, at[1] - at[0])[0]
        p = np.where(np.isfinite(best)[:, None], _sigmoid(np.maximum(best, -1e6)[:, None] - self.model.theta[None, :]), 0.0)
        return p.sum(axis=1), p[:, 0]


def verdict_sample(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str, most: int = MAX_VERDICTS, most_chars: int = MAX_VERDICT_CHARS) -> DataFrame:
    """id, text, y (1: yes) of at most ``most`` documents, of at most ``most_chars`` characters together: those reviewed with one opinion, or with a majority for one.

    A bounded sample, the first by a hash of the id. Only its texts move; the documents are read once and not shuffled.
    """
    o = F.xxhash64("id")
    v = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id")).agg(F.sum(label).alias("yes"), F.count(F.lit(1)).alias("n")).where("2 * yes <> n")
        .select("id", (F.col("yes") * 2 > F.col("n")).cast("int").alias("y")).orderBy(o, "id").limit(most)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(v), "id")  # at most ``most`` rows
    run = F.sum(F.length("text")).over(Window.partitionBy(F.lit(0)).orderBy(o, "id", F.md5("text")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", run).where(F.col("__run") <= most_chars).drop("__run")


def fit(sample: DataFrame, classes: dict[str, str] = CLASSES, examples: str = EXAMPLES, rounds: int = ROUNDS) -> AbuseModel:
    """A model fitted in one task on what verdict_sample gives; only the model, a megabyte, reaches the driver."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = train(list(zip(pdf["text"], pdf["y"])), classes, examples, rounds)
        return pd.DataFrame({"weights": [m.weights.tobytes()], "theta": [m.theta.tolist()]})

    got = sample.select("text", "y").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "weights binary, theta array<double>").first()
    if got is None:  # no verdict at all
        return train([], classes, examples, rounds)
    return AbuseModel(np.frombuffer(bytes(got["weights"]), np.float32), np.array(got["theta"]), classes)


def score_texts(docs: DataFrame, doc_id: str, text: str, model: AbuseModel, extra: list[Column] | None = None, flag_at: float = FLAG_AT) -> DataFrame:
    """doc_id, extra columns, severity (0 to 3, expected), probability (of grade 1 or more), abusive (probability >= ``flag_at``).

    One row per row of ``docs``, whole texts. Null, empty and blank texts have severity and probability 0. Repeated
    texts score alike. Ids may be null or repeat; they only pass through. An empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader = Grader(model)
        for b in batches:
            severity, probability = grader.grade(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(severity, pa.float64()), pa.array(probability, pa.float64())], [*b.schema.names[:-1], "severity", "probability"])

    rows = docs.select(F.col(doc_id), *(extra or []), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{schema}, severity double, probability double").withColumn("abusive", F.col("probability") >= flag_at)
