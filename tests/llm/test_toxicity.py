import math
import random
import re

import pytest

import odd
from plumbob.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    "text, toxic",
    [
        ("You are a complete idiot.", True),
        ("The weather is fine. What an idiot!", True),
        ("I will kill you", True),
        ("You are not an idiot.", False),
        ("They said the man was an idiot.", False),
        ("He will not kill you", False),
        ("How to kill a process; how to kill time", False),
        ("Du bist ein Dummkopf", True),
        ("The idiotic word inside preidiots isn't matched", False),
        ("take out the trash", False),
        ("This garbage collector is worthless", False),
        ("the old man and his clown loves you", False),
        ("He is hardly an idiot", False),
        ("You are anything but an idiot", False),
        ("Nobody is going to kill you", False),
        ("kill this process", False),
        ("an idiot", False),
        ("You are garbage", True),
        ("They are all pathetic losers", True),
        ("kill the process before someone else asks you", False),
        ("kill all of them", True),
        ("He is an idiot. " + "Fine words in a long text of many clauses. " * 400, False),
        ("Trash is collected on Monday. The trash goes here. Trash again. " * 20, False),
        ("One moron there. And a clown here. Then scum.", True),
        ("", False),
        (None, False),
    ],
)
def test_clauses(text, toxic):
    assert (T.Scorer().text(text)[0] >= T.THRESHOLD) is toxic


def test_only_the_clause_counts():
    s = T.Scorer()
    assert s.text("You are not stupid. Stupid!")[1:] == (0.4, 2)
    assert s.text("She said no. You idiot.")[0] == 1.0  # reported speech ends with its clause


def test_scattered_words_of_a_long_text_are_not_toxic():
    fine = "Some fine words that make a long and clean text. " * 300
    assert not T.Scorer().text(fine + "Kill it. " + fine + "They hurt. " + fine + "A clown. " + fine + "Some trash. ")[0] >= T.THRESHOLD


def test_transducers_compose_like_a_sequence():
    flip = T.Transducer(0, {(0, "a"): (1, "b", 0.5), (1, "a"): (0, "a", 1.0)})
    mark = T.Transducer("x", {("x", "a"): ("x", "A", 2.0), ("x", "b"): ("x", "B", 3.0)})
    both = flip.compose(mark)
    assert both.arcs[(0, "x"), "a"] == ((1, "x"), "B", 1.5) and both.arcs[(1, "x"), "a"] == ((0, "x"), "A", 2.0)


def in_sequence(kinds):
    """Weights of a clause's classes, one transducer after the other."""
    symbols, weights = list(kinds), [1.0] * len(kinds)
    for machine in T.stages():
        state = machine.start
        for i, x in enumerate(symbols):
            state, symbols[i], w = machine.arcs[state, x]
            weights[i] *= w
    return [w if x == "W" else 0.0 for x, w in zip(symbols, weights)]


def by_rules(kinds):
    """The same by the docstring's sentences, word by word."""
    out = []
    for i, x in enumerate(kinds):
        before = range(i)
        negations = [j for j in before if kinds[j] == "N" or kinds[j] == "B" and j and kinds[j - 1] == "A"]
        persons = [j for j in before if kinds[j] == "G" or kinds[j] == "D" and j and kinds[j - 1] == "X"]
        less = 0.2 ** any(i - j <= T.NEGATED for j in negations) * 0.2 ** ("R" in kinds[:i])
        aimed = any(i - j <= T.AIMED for j in persons)
        out.append((0.3 if aimed else 0.2) * less if x == "T" else (1.0 if aimed else T.ALONE if x == "I" else T.ALONE / 5) * less if x in "IM" else 0.0)
    for i, x in enumerate(kinds):
        if x == "G":
            struck = [j for j in range(max(0, i - T.STRUCK), i) if kinds[j] == "T"]
            if struck and "G" not in kinds[struck[-1] : i]:
                j = struck[-1]
                out[i] = out[j] / (0.3 if round(out[j], 9) in (0.3, 0.06, 0.012) else 0.2) * (1.2 if round(out[j], 9) in (0.3, 0.06, 0.012) else 1.0)
    return out


def test_machine_against_sequence_and_rules():
    rng = random.Random(2)
    start, table = T.grammar()
    for _ in range(3000):
        kinds = rng.choices(T.PLAIN, [3, 1, 2, 3, 2, 1, 1, 1, 1, 1, 4], k=rng.randint(1, 14))
        state, got = start, []
        for x in kinds:
            state, w = table[state][x]
            got.append(w)
        assert got == pytest.approx(in_sequence(kinds)), kinds
        assert got == pytest.approx(by_rules(kinds)), kinds


def brute(scorer, text):
    """A document's score from all its clauses, without the word search."""
    if not text:
        return 0.0, 0.0, 0
    strong, faint, weights = 0.0, {}, []
    for clause in re.split(r"[.!?;:\n\r…。]+", text.lower()):
        words = re.findall(r"\w+", clause)
        kinds = [scorer.word(w) for w in words]
        factors = by_rules([k for k, _ in kinds])
        if not any(k in "IMT" for k, _ in kinds):
            continue
        parts, threat = [], None
        for w, (k, weight), factor in zip(words, kinds, factors):
            threat = (w, weight) if k == "T" else threat
            if factor:
                parts.append((factor * (weight if k in "IMT" else threat[1]), w if k in "IMT" else threat[0]))
        weight = sum(x for x, _ in parts)
        if not weight:
            continue
        weights.append(weight)
        if weight >= T.THRESHOLD:
            strong += weight
        elif weight > T.FAINT:
            w = max(parts, key=lambda p: p[0])[1]
            faint[w] = max(faint.get(w, 0), weight)
    return (strong + sum(faint.values())) / max(1.0, len(text.split()) / 1000), max(weights, default=0.0), len(weights)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = T.Scorer(T.learn(docs, labels))
    want = {r.doc_id: brute(scorer, r.text) for r in docs.collect()}
    got = {r.doc_id: (r.score, r.worst, r.clauses) for r in T.op1_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_learnt_words_and_labels_by_hand(spark):
    """Labels that disagree count as toxic; of nested beginnings as telling the
    shortest, of equal words both are learnt; weights are log-odds."""
    docs = odd.plain(spark, [(i, f"blorp{i % 4}x zrug and wamp") for i in range(20)] + [(100 + i, "good and plain") for i in range(30)])
    rows = [(i, 1, 1) for i in range(20)] + [(i, 1, 0) for i in range(10)] + [(100 + i, 1, 0) for i in range(30)]
    labels = spark.createDataFrame(rows, LABELS)
    odds = min(1.0, math.log(20.5 / 21 / (0.5 / 31)) / T.FULL)
    assert T.learn(docs, labels) == pytest.approx({"blor*": odds, "wamp": odds, "zrug": odds})
    assert T.learn(docs, labels.union(labels)) == T.learn(docs, labels)
    assert T.learn(docs, labels.limit(0)) == {} == T.learn(docs.limit(0), labels)


def test_held_out_labels(spark):
    """Learnt from half of the labels, judged on the others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.toxic for r in T.toxicity(docs, labels.where("doc_id % 2 = 0")).collect()}
    bad, good = [got[i] for i, t in held.items() if t], [got[i] for i, t in held.items() if not t]
    print("held out", sum(bad) / len(bad), sum(good) / len(good))
    assert sum(bad) / len(bad) >= 0.85 and sum(good) / len(good) <= 0.02


def test_learnt_words_and_held_out_accuracy(spark):
    good = [(i, f"plain words about gardens number {i} and rivers") for i in range(60)]
    bad = [(100 + i, f"you grumbletor{'abcdef'[i % 6]} of gardens grumbletor{'abcdef'[i % 5]} number {i}") for i in range(60)]
    docs = odd.plain(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 1, 1) for i, _ in bad[:40]] + [(5, 1, 0), (None, 1, 1), (7, 1, None), (9999, 0, 1)], LABELS)
    held = {r.doc_id: r.toxic for r in T.toxicity(docs, labels).collect()}
    assert not any(held[i] for i, _ in good) and all(held[i] for i, _ in bad)


def test_generated_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.toxic for r in T.op1_toxicity(spark, sf).collect()}
    rows = [(got[r.doc_id], bool(r.toxic)) for r in labels.collect()]
    assert sum(a and b for a, b in rows) >= 0.85 * sum(b for _, b in rows)
    assert sum(a and not b for a, b in rows) <= 0.02 * sum(not b for _, b in rows)


def test_odd_documents(spark):
    docs, labels = odd.documents(spark), spark.createDataFrame([], LABELS)
    assert T.toxicity(docs, labels).count() == docs.count()
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert T.without_toxic(docs.limit(0), labels).count() == 0
    late = T.toxicity(odd.plain(spark, [(1, "fine words. " * 30_000 + "you idiot")]), labels).first()
    assert (late.worst, late.clauses, late.toxic) == (1.0, 1, False)
    repeated = T.toxicity(odd.plain(spark, [(1, "you idiot"), (1, "you idiot"), (None, "you idiot")]), labels)
    assert [r.toxic for r in repeated.collect()] == [True] * 3
