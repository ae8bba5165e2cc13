"""Abuse scores: disguises, vectorised windows against plain ones, verdicts, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import abuse
from skarn.llm.abuse_words import EXAMPLES
from tests.conftest import DATA


def _words(text: str) -> list[str]:
    """The words of a text in their plain form."""
    r = abuse.Reader.of(abuse.CLASSES)
    seen: dict[int, str] = {}
    plain_word = r.word

    def spy(t: str) -> str:
        w = plain_word(t)
        seen[1 + abuse.crc32(w.encode())] = w
        return w

    r.word = spy
    return [seen[int(h)] for h in r.read(pa.array([text])).hash]


def test_disguises():
    assert _words("you 1mb3c1l3") == ["you", "imbecile"] and _words("w.a.n.k.e.r.s") == ["wanker"] and _words("a s t u p i d m***n") == ["a", "stupid", "moron"]
    assert _words("@$$h0l3 b*stard p******e") == ["asshole", "bastard", "parasite"] and _words("hooooorny іmbecіle cu​nt") == ["horny", "imbecile", "cunt"]
    assert _words("**at** 11.5% $QUBRAX rates") == ["at", "#", "#", "$qubrax", "rates"] and _words("") == [] and _words("Scheiße") == ["scheisse"]
    assert _words("<b>id</b>iot <!-- idiot -->") == ["idiot", "idiot"]


def test_a_batch_is_scored_as_its_texts_are_alone():
    """Running sums over a batch give what a loop over windows gives."""
    rng = np.random.default_rng(5)
    texts = ["", None, "one", "you idiot! go home.", *[" ".join(rng.choice(["you", "idiot", "the", "a.", "fell\n", "kill", "12", "jews"], rng.integers(1, 40))) for _ in range(60)]]
    r = abuse.Reader.of(abuse.CLASSES)
    weights = rng.normal(size=abuse.BUCKETS)
    x = r.read(pa.array(texts))
    best, first, last = abuse.worst_windows(x, abuse.position_features(x, len(r.kinds)), weights, len(texts))
    for i, t in enumerate(texts):
        one = r.read(pa.array([t], pa.string()))
        f = abuse.position_features(one, len(r.kinds))
        n = len(one.hash)
        want = [-np.inf]
        for e in range(n):
            s = next(s for s in range(e + 1) if one.sentence[s] == one.sentence[e] and e - s < abuse.WINDOW)
            want.append(weights[abuse.window_rows(f, np.array([s]), np.array([e]))[0]].sum())
        assert best[i] == pytest.approx(max(want)) and (n == 0 or last[i] - first[i] < abuse.WINDOW)


def test_ordinal_fit_orders_the_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    rows = [np.array([1] * int(g) + [2 + int(rng.integers(0, 5))]) for g in grade]
    w, theta = abuse.fit_ordinal(rows, grade, grade, np.ones(400), rounds=600)
    assert w[1] > 0 and list(theta) == sorted(theta) and len(theta) == abuse.GRADES
    s = np.array([w[r].sum() for r in rows])
    assert np.mean((s[:, None] > theta[None, :]).sum(axis=1) == grade) > 0.95


def test_examples_and_verdicts_make_a_model():
    ordinary = [f"net debt of firm {i} rose in the quarter and the board said {i} plants were idle" for i in range(60)]
    m = abuse.train([(t, 0) for t in ordinary] + [("the auditor is a blithering nincompoop", 1)] * 3)
    severity, p = abuse.Grader(m).grade(pa.array(["you are a useless moron", "i will kill you and your family", ordinary[3], "", None]))
    assert p[0] > abuse.FLAG_AT < p[1] and p[2] < abuse.FLAG_AT and severity[1] > severity[0] > severity[2] and list(p[3:]) == [0, 0]


def test_copies_of_an_abusive_text_count(spark):
    """A third of the rows is one abusive text in words the examples lack; its verdicts must still count."""
    bad = "go boil your flimsy head you glorbous wimbly snarfle"
    rows = [(i, bad if i % 3 == 0 else f"the firm {i} reported net debt of {i} million for the quarter") for i in range(90)]
    docs = spark.createDataFrame(rows + [(99, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(50, 1), (50, 0), (51, None)], "doc_id int, abusive int")
    sample = abuse.verdict_sample(docs, "doc_id", "text", labels, "abusive")
    assert sample.count() == 40 and abuse.verdict_sample(docs, "doc_id", "text", labels, "abusive", most=7).count() == 7
    assert 0 < abuse.verdict_sample(docs, "doc_id", "text", labels, "abusive", most_chars=200).count() < 5
    got = {r["text"]: r["abusive"] for r in abuse.score_texts(docs, "doc_id", "text", abuse.fit(sample), [F.col("text")]).collect()}
    assert got.pop(bad) and not any(got.values())


def test_verdicts_the_others_contradict_do_not_count():
    fine = [f"net debt of firm {i} rose in the quarter and {i % 7} plants were idle" for i in range(80)]
    foul = [f"you are a stupid {w}, go to hell, said the man of firm {i}" for i, w in enumerate(["idiot", "moron", "bastard", "loser"] * 8)]
    told = abuse.settled([*((t, 0) for t in fine[1:]), *((t, 1) for t in foul), (fine[0], 1), (fine[1], 1), ("", 1), (None, 0)])
    kept = {v[0]: v[1] for v in abuse.believable(told)}
    assert fine[0] not in kept and fine[1] not in {v[0] for v in told} and sum(kept.values()) > 28 and set(kept.values()) == {0, 1}
    assert (fine[0], 1, 3) in abuse.believable(abuse.settled([(fine[0], 1)] * 3 + [(t, 0) for t in fine[1:]]))


def test_held_out_accuracy(spark):
    """Fitted on the verdicts of one scale, scored on those of a larger one, where about one verdict in eight for 'yes' is wrong."""
    read = lambda sf, n: spark.read.parquet(f"{DATA}/{sf}/{n}.parquet")
    sample = lambda sf: abuse.verdict_sample(read(sf, "documents"), "doc_id", "text", read(sf, "review_labels"), "abusive")
    got = abuse.score_texts(sample("sf0.01"), "id", "text", abuse.fit(sample("sf0.1")), [F.col("y")]).select("abusive", "y").toPandas()
    assert (got["abusive"] == (got["y"] == 1)).mean() > 0.9


def test_no_graded_example_shares_four_words_with_the_test_tables(spark):
    from skarn.llm.text import WORD, plain

    def runs(t: str) -> set[tuple[str, ...]]:
        w = WORD.findall(plain(t.lower()))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    mine = {g: line for line in EXAMPLES.strip().splitlines() for g in runs(line.split("|", 1)[1])}
    texts = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("text is not null").select("text").distinct().collect()
    assert sorted({mine[g] for r in texts for g in runs(r[0]) & mine.keys()}) == []


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, " \n "), (4, "you idiot " * 20000), (4, "fine")], "doc_id int, text string")
    m = abuse.train([("fine words about nothing at all", 0), ("net debt rose in the quarter", 0), ("fine", 0)])
    got = abuse.score_texts(df, "doc_id", "text", m).collect()
    assert [r["abusive"] for r in got] == [False, False, False, True, False] and got[0]["severity"] == 0.0
    assert abuse.score_texts(df.limit(0), "doc_id", "text", m).count() == 0
    none = abuse.verdict_sample(df.limit(0), "doc_id", "text", spark.createDataFrame([], "doc_id int, abusive int"), "abusive")
    assert abuse.fit(none).weights.any()
