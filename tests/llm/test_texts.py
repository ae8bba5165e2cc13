"""Near-same records, leaked passages and mixing."""

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn.llm import json_overlap, leaks
from skarn.llm.json_overlap import leaf_values, near_same_records
from skarn.llm.leaks import banded_edits, leaked_passages
from skarn.llm.mixing import count_tokens, mix_sources
from skarn.llm.text import words


def differing(a, b, tol=0.001):
    n = 0
    for p in a.keys() | b.keys():
        x, y = a.get(p), b.get(p)
        if x == y or (x and y and x[0] == y[0] == "n" and abs(float(x[1:]) - float(y[1:])) <= tol * (1 + 1e-6)):
            continue
        n += 1
    return n


def test_leaf_values():
    f = leaf_values
    assert f('{"a": {"b": " X "}, "c": [1, null, "2.50"], "d": true, "e": "1E9", "f": "1e999"}') == {".a.b": "tx", ".c.0": "n1.0", ".c.2": "n2.5", ".d": "ttrue", ".e": "n1000000000.0", ".f": "t1e999"}
    assert f(None) is None and f("  ") is None and f("{}") == {} and f("{broken") == {"": "t{broken"} and f("12E45678")[""].startswith("t")


def test_near_same_against_brute_force(spark):
    rnd = random.Random(4)
    base = [{"id": f"x{i}", "name": f"company {i % 9}", "when": {"day": f"2020-01-{i % 28 + 1:02}", "time": f"{i}:00"}, "nums": {k: round(rnd.uniform(-3, 3), 6) for k in "abcdef"}, "kind": "same"} for i in range(40)]
    recs = []
    for o in base:
        for _ in range(6):
            c = json.loads(json.dumps(o))
            for _ in range(rnd.randrange(0, 6)):
                k = rnd.choice(["id", "name", "a", "b", "c", "day", "drop", "tiny", "text", "case"])
                if k in "abc":
                    c["nums"][k] = round(rnd.uniform(-3, 3), 6)
                elif k == "day":
                    c["when"]["day"] = f"2021-02-{rnd.randrange(1, 28):02}"
                elif k == "drop":
                    c["nums"].pop(rnd.choice("def"), None)
                elif k == "tiny":
                    c["nums"]["e"] = c["nums"].get("e", 1.0) + rnd.choice([-0.001, 0.0009, 0.00101, -0.0005])
                elif k == "text":
                    c["nums"]["f"] = str(c["nums"].get("f"))
                elif k == "case":
                    c["name"] = f" {str(c['name']).upper()} "
                else:
                    c[k] = f"other {rnd.randrange(5)}"
            recs.append((len(recs) + 1, rnd.choice([True, True, False]), json.dumps(c, indent=rnd.choice([None, 1])), "own"))
    recs += [(900, True, None, ""), (901, False, "", ""), (902, True, "{}", ""), (903, None, recs[0][2], ""), (904, True, "not json", ""), (905, False, " Not JSON", ""), (906, False, "{}", "")]
    recs += [(1000 + i, i % 2 == 0, recs[5][2], "") for i in range(6)]
    pairs, members, _ = near_same_records(spark.createDataFrame(recs, "rid int, train boolean, text string, class string").repartition(3), "rid", F.col("text"), F.col("train"))
    m = members.collect()
    of = {}
    for r in m:
        of.setdefault((bytes(r["class"]), r["train"]), []).append(r["rid"])
    got = sorted((a, b, p["differing"]) for p in pairs.collect() for a in of[(bytes(p["train_class"]), True)] for b in of[(bytes(p["eval_class"]), False)])
    leaves = {r[0]: leaf_values(r[2]) for r in recs}
    want = sorted((a[0], b[0], n) for a in recs for b in recs if a[1] is True and b[1] is False and leaves[a[0]] is not None and leaves[b[0]] is not None and (n := differing(leaves[a[0]], leaves[b[0]])) <= 3)
    assert got == want and {(904, 905, 0), (902, 905, 1), (902, 906, 0)} <= {*got} and len(got) > 100
    empty = near_same_records(spark.createDataFrame([], "rid int, train boolean, text string"), "rid", F.col("text"), F.col("train"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def _records(n: int, rnd: random.Random, absent: float) -> list[tuple[int, bool, str]]:
    """Records of 20 leaves, of whose first five all are absent in a share of them, and near copies."""
    out: list[tuple[int, bool, str]] = []
    for i in range(n):
        o = {f"f{j:02}": rnd.choice([round(rnd.uniform(0, 9), 4), f"v{rnd.randrange(50)}"]) for j in range(20)}
        if rnd.random() < absent:
            for j in (0, 4, 8, 12, 16):
                o.pop(f"f{j:02}")
        for t in (True, False):
            c = dict(o)
            for k in rnd.sample(sorted(c), rnd.randrange(0, 5)):
                c[k] = c[k] + rnd.choice([0.0009, 1]) if isinstance(c[k], float) else c[k] + "x"
            out.append((len(out), t, json.dumps(c)))
    return out


def _found(spark, recs) -> tuple[list, dict]:
    pairs, members, coverage = near_same_records(spark.createDataFrame(recs, "rid int, train boolean, text string").repartition(3), "rid", F.col("text"), F.col("train"))
    of: dict = {}
    for r in members.collect():
        of.setdefault((bytes(r["class"]), r["train"]), []).append(r["rid"])
    return sorted((a, b, p["differing"]) for p in pairs.collect() for a in of[(bytes(p["train_class"]), True)] for b in of[(bytes(p["eval_class"]), False)]), {bytes(r["class"]): r["covered"] for r in coverage.collect()}


def _wanted(recs) -> list:
    leaves = {r[0]: leaf_values(r[2]) for r in recs}
    return sorted((a[0], b[0], n) for a in recs for b in recs if a[1] and not b[1] and (n := differing(leaves[a[0]], leaves[b[0]])) <= 3)


@pytest.mark.parametrize("hot", [10**6, 40])
def test_near_same_with_a_passage_most_records_share(spark, monkeypatch, hot):
    """A passage whose leaves are absent in most records is searched again with halves of the others; no pair is lost."""
    monkeypatch.setattr(json_overlap, "HOT_PAIRS", hot)
    monkeypatch.setattr(json_overlap, "SHARD_PASSAGES", 90)
    monkeypatch.setattr(json_overlap, "SLICE_TEXTS", 30)
    recs = _records(150, random.Random(11), 0.6)
    got, covered = _found(spark, recs)
    assert got == _wanted(recs) and len(got) > 80 and 0 < min(covered.values()) and max(covered.values()) == 1


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_near_same_with_several_hot_passages(spark, monkeypatch, most):
    """Pairs that agree in hot passages only, with several differences in one of the others, are found, and cover what they share."""
    rnd = random.Random(13)
    recs = _records(100, rnd, 0.6)
    leaves = {r[0]: leaf_values(r[2]) for r in recs}
    want = sorted((a[0], b[0], n) for a in recs for b in recs if a[1] and not b[1] and (n := differing(leaves[a[0]], leaves[b[0]])) <= most)
    df = spark.createDataFrame(recs, "rid int, train boolean, text string").repartition(3)
    found = []
    for hot in (10**6, 0):
        monkeypatch.setattr(json_overlap, "HOT_PAIRS", hot)
        pairs, members, _ = near_same_records(df, "rid", F.col("text"), F.col("train"), most)
        side = lambda c, t: members.where(F.col("train") == t).select(F.col("class").alias(f"{c}_class"), F.col("rid").alias(c))
        rows = pairs.join(side("train", True), "train_class").join(side("eval", False), "eval_class").select("train", "eval", "differing", "covered").collect()
        found.append(sorted(map(tuple, rows)))
    assert [r[:3] for r in found[1]] == want and len(want) > 10 and found[0] == found[1]


def test_pairs_come_from_the_scan(spark, monkeypatch):
    """Without what the automata find there are no pairs and no coverage."""
    recs = _records(30, random.Random(12), 0.1)
    assert _found(spark, recs)[0]
    monkeypatch.setattr(json_overlap, "scan_texts", lambda coded: coded.where("false").selectExpr("key as train_class", "h", "start", "end"))
    assert _found(spark, recs) == ([], {})


def test_automata_scan_whole_texts():
    train = pd.DataFrame({"key": [b"a", b"b"], "text": ["0:AABB1:CCDD", "0:AAXX1:CCDD"]})
    evaluation = pd.DataFrame({"h": [1, 2, 3], "start": [0, 2, 0], "end": [2, 4, 2], "passage": ["0:AABB", "1:CCDD", "0:ZZZZ"]})
    got = json_overlap._scan((0, 0), train, evaluation)
    assert [*got.itertuples(index=False, name=None)] == [(b"a", 1, 0, 2), (b"a", 2, 2, 4), (b"b", 2, 2, 4)]
    assert len(json_overlap._scan((0, 0), train, evaluation[:0])) == 0


def test_merged_length(spark):
    rows = [([(0, 2), (2, 4)], 4), ([(3, 7), (0, 5), (8, 9)], 8), ([(1, 3), (1, 3)], 2), ([], 0)]
    df = spark.createDataFrame(rows, "x array<struct<start:int,end:int>>, n int")
    assert df.where(json_overlap.merged_length(F.col("x")) != F.col("n")).count() == 0


def test_near_edges_of_many_numbers_stay_few(spark):
    """A record all of whose numbers lie on edges of cells has at most 2^8 spellings a passage."""
    edge = (3 - json_overlap.CELL_OFFSET) * 0.064
    o = {f"n{i:03}": edge for i in range(120)}
    recs = [(0, True, json.dumps(o)), (1, False, json.dumps({k: v + 0.0008 for k, v in o.items()})), (2, True, json.dumps({k: v + i for i, (k, v) in enumerate(o.items())}))]
    assert _found(spark, recs)[0] == [(0, 1, 0)]


def test_words():
    assert words("<p>Net&nbsp;debt</p> ro­se 1,204.5% ​in Ma​rch_x É") == ["net", "nbsp", "debt", "rose", "1", "204", "5", "in", "march", "x", "é"]
    assert words(None) == [] and words(" ... ") == [] and words("a < b > c") == ["a", "b", "c"]


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    monkeypatch.setattr(leaks, "CHUNK_CHARS", 1500)
    rnd = random.Random(6)
    vocab = [f"w{i}" if i % 5 else "a" * (i % 3 + 1) for i in range(60)] + ["margin", "revenue", "quarter"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([3, 9, 10, 14, 40]))) for i in range(60)] + [(100, None), (101, ""), (102, "<b>" + text(12) + "</b>")]
    docs = []
    for i in range(250):
        t = text(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 3)):
            w = (rnd.choice(items)[1] or "x").split()
            k = rnd.randrange(len(w)) if w else 0
            part = w[k : k + rnd.randrange(5, 30)]
            t += " " + rnd.choice([" ".join(part), "\n> ".join(part), ", ".join(part).upper(), "</i> ".join(part)]) + " " + text(4)
        docs.append((i, t))
    docs += [(900, None), (901, " "), (902, text(2000) + " " + items[5][1] + " " + text(2000)), (903, docs[0][1])]
    grams = lambda t: {tuple(w[i : i + 10]) for w in [words(t)] for i in range(len(w) - 9)}
    want = sorted((d, i) for d, t in docs for i, s in items if grams(t) & grams(s))
    out = leaked_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id int, text string"), "item_id", "text", edits=1)
    rows = out.collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0) == want and len(want) > 20
    assert leaked_passages(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").count() == 0
    assert leaked_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame([], "item_id int, text string"), "item_id", "text").count() == 0


def test_near_passages(spark):
    item = "revenue of the segment rose sharply in the third quarter of last year"
    docs = [(1, "so " + item), (2, "so " + item.replace("sharply", "sharplx")), (3, item.replace("segment rose", "segmnt rse")), (4, item.replace("third", "second"))]
    find = lambda k: {r["doc_id"]: r["edits"] for r in leaked_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame([(7, item)], "item_id int, text string"), "item_id", "text", edits=k).collect()}
    assert find(0) == {1: 0} and find(1) == {1: 0, 2: 1} and find(2) == {1: 0, 2: 1, 3: 2}


def _least_edits(p: str, s: str) -> int:
    """The least edits between ``p`` and any part of ``s``, by the whole table."""
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j in range(1, len(s) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (s[j - 1] != c)))
        row = new
    return min(row)


@pytest.mark.parametrize("block", [10**6, 700])
def test_every_planted_passage_with_one_edit_is_found(spark, monkeypatch, block):
    """Recall of near passages: one character put in, taken out or changed, anywhere inside; checked against whole tables."""
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    monkeypatch.setattr(leaks, "CHUNK_CHARS", 900)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5, 8])))
    items = [(i, " ".join(word() for _ in range(rnd.choice([10, 12, 20])))) for i in range(30)]
    docs = [(1000 + i, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(40)]
    planted = []
    for n in range(200):
        i, t = rnd.choice(items)
        w = t.split()
        k = rnd.randrange(len(w) - 9)
        p = " ".join(w[k : k + 10])
        at = rnd.randrange(1, len(p) - 1)
        kind = rnd.randrange(3)
        p = p[:at] + ("z" if kind < 2 else "") + p[at + (kind != 0) :]
        docs.append((n, " ".join([word() for _ in range(rnd.randrange(0, 9))] + [p] + [word() for _ in range(rnd.randrange(0, 9))])))
        planted.append((n, i))
    find = leaked_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id int, text string"), "item_id", "text")
    rows = {(r["doc_id"], r["item_id"]): (r["edits"], r["passages"]) for r in find.collect()}
    pad = lambda t: f" {' '.join(words(t))} "
    of = dict(docs)
    missed = [x for x in planted if x not in rows]
    assert len(rows) >= 190 and len(missed) < 5
    for d, i in [*missed, *[*rows][:60]]:
        w = words(dict(items)[i])
        n = [_least_edits(f" {' '.join(w[k:k + 10])} ", pad(of[d])) for k in range(len(w) - 9)]
        # a word of one letter that was taken out took its space along: two edits
        assert rows[d, i] == (min(n), n.count(min(n))) if (d, i) in rows else min(n) > 1


def test_passages_of_a_long_text_are_counted_over_its_parts(spark, monkeypatch):
    """Cutting a text changes neither edits nor the number of passages."""
    rnd = random.Random(3)
    item = " ".join(f"w{rnd.randrange(999)}" for _ in range(60))
    w = item.split()
    text = " ".join([*w[:25], *["and"] * 300, *w[20:50], *["so"] * 300, *w[:15]])
    counts = set()
    for chunk in (10**6, 400):
        monkeypatch.setattr(leaks, "CHUNK_CHARS", chunk)
        got = leaked_passages(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", spark.createDataFrame([(7, item)], "item_id int, text string"), "item_id", "text").collect()
        counts.add(tuple((r["edits"], r["passages"]) for r in got))
    assert counts == {((0, 16 + 21),)}


def test_banded_edits():
    assert banded_edits("kitten", "xxkittenyy", 2, 2) == 0 and banded_edits("kitten", "xxsittenyy", 2, 2) == 1 and banded_edits("kitten", "xxsitingyy", 2, 2) == 3


def mix(spark, data, targets, **kw):
    c = count_tokens(spark.createDataFrame(data, "doc_id int, source string, text string"), "doc_id", F.col("source"), "text")
    sel, rep = mix_sources(c, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **kw)
    return sel.collect(), {r["source"]: r for r in rep.collect()}


def test_mixing(spark):
    rnd = random.Random(8)
    data = [(i, rnd.choices(["big", "mid", "small", "extra", None], [70, 20, 4, 5, 1])[0], " ".join(f"token{rnd.randrange(999)}" for _ in range(rnd.randrange(1, 40)))) for i in range(900)]
    data += [(2000 + i, "big", data[3][2]) for i in range(300)] + [(5000, "small", None), (5001, "small", ""), (5002, "absent", "x")]
    targets = [("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.2, 2), ("none", 0.1, 9), (None, 0.5, 1)]
    sel, rep = mix(spark, data, targets, blocks=500, shard_tokens=2000, seed=3)
    of = {i: (s, t) for i, s, t in data}
    texts = Counter()
    for r in sel:
        assert r["source"] == of[r["id"]][0] and 1 <= r["repeats"] <= {"big": 1, "mid": 3, "small": 2}[r["source"]]
        texts[of[r["id"]][1]] += r["repeats"]
    assert texts[data[3][2]] <= 3
    total = sum(r["tokens"] for r in sel)
    assert {r["wanted"] for r in rep.values() if r["source"] == "none"} and rep["none"]["short"] and rep["small"]["short"] and not rep["mid"]["short"]
    reached = Counter()
    for r in sel:
        reached[r["source"]] += r["tokens"] * r["repeats"]
    assert {s: r["reached_tokens"] for s, r in rep.items() if r["reached_tokens"]} == dict(reached) and total
    assert (sel, rep) == mix(spark, data[::-1], targets, blocks=500, shard_tokens=2000, seed=3) or sorted(sel) == sorted(mix(spark, data[::-1], targets, blocks=500, shard_tokens=2000, seed=3)[0])
    assert mix(spark, [], targets)[0] == []


def test_mixing_reaches_feasible_targets(spark):
    data = [(i, "ab"[i % 2], f"text number {i} " + "word " * (i % 30)) for i in range(2000)]
    _, rep = mix(spark, data, [("a", 0.75, 4), ("b", 0.25, 4)], blocks=400, shard_tokens=10_000)
    assert rep["a"]["reached_share"] == pytest.approx(0.75, abs=0.02) and not rep["a"]["short"]


def test_mixing_with_blocks_larger_than_a_sources_part_of_a_shard(spark):
    data = [(i, "rare" if i % 50 == 0 else "ab"[i % 2], f"text number {i} " + "word " * (i % 30)) for i in range(2000)]
    sel, rep = mix(spark, data, [("a", 0.5, 1), ("b", 0.4, 1), ("rare", 0.1, 2)], blocks=60, shard_tokens=300)
    size = sum(r["tokens"] for r in rep.values()) // 60
    assert size > 2 * 300 * rep["rare"]["tokens"] / (60 * size)  # no shard's part fills a block
    assert {r["id"]: r["repeats"] for r in sel if r["source"] == "rare"} == {i: 2 for i in range(0, 2000, 50)}
    assert rep["rare"]["reached_tokens"] == 2 * rep["rare"]["tokens"]
    assert 58 * size < sum(r["reached_tokens"] for r in rep.values()) < 62 * size


def test_tokenizers_agree_on_counts_roughly():
    import os

    from skarn.functions.tokens import token_counter

    t = "Net debt rose by 12.5 percent in the third quarter."
    n = [token_counter(p)(t) for p in ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model") if os.path.exists(p)]
    assert len(n) == 3 and n[0] == n[1] and abs(n[2] - n[0]) < 6


def test_very_long_and_odd_texts_are_counted_whole():
    from skarn.functions.tokens import pieces, token_counter
    from skarn.llm.text import visible

    n = token_counter()
    assert n("word " * 200_000) == pytest.approx(200_000, rel=0.01) and n(" " * 2_000_000) > 0 and n("\ud800 x") > 0 and n("") == 0
    t = "ab cd\n" * 30_000 + "x" * 120_000
    assert "".join(pieces(t)) == t and max(map(len, pieces(t))) <= 50_000
    assert visible("a<!-- x --> b<!-- c" + "<!--" * 50_000) == "a x  b c"
