import random

import numpy as np
import pytest

import odd
from plumbob.llm import decontaminate as D
from plumbob.llm.common import one_text_words

ITEMS = "item_id long, text string, doc_id string"


def words(rng, n):
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: again and again the longest
    match of what is unmarked."""
    least = max(1, min(least, len(item)))
    free_d, free_p, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_p[i + n] and free_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            free_p[i + k] = free_d[j + k] = False
        total += n


@pytest.mark.parametrize("seed", range(25))
def test_tiles_against_the_definition(seed):
    rng = random.Random(seed)
    alphabet = [f"w{i}" for i in range(rng.choice([2, 3, 8, 40]))]
    item = rng.choices(alphabet, k=rng.randint(1, 25))
    cut = rng.randint(0, len(item))
    doc = rng.choices(alphabet, k=rng.randint(0, 15)) + item[cut:] + rng.choices(alphabet, k=3) + item[:cut] + rng.choices(alphabet, k=5)
    a, b = one_text_words(" ".join(doc)), one_text_words(" ".join(item))
    tiles = D.tile(a, b, 3)
    assert sum(t[2] for t in tiles) == brute_tiles(doc, item, 3)
    marked = [set(), set()]
    for j, i, n in tiles:
        assert (a[j : j + n] == b[i : i + n]).all()
        for k in range(n):
            assert i + k not in marked[0] and j + k not in marked[1]
            marked[0].add(i + k)
            marked[1].add(j + k)


def corpus(seed=1):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(20, 60))) for k in range(12)]
    docs = []
    for i in range(60):
        text = words(rng, rng.randint(20, 500))
        if i % 3 == 0:
            item = items[rng.randrange(12)][1]
            third = len(item) // 3
            piece = {0: item, 1: item[2 * third :] + words(rng, 2) + item[:third] + words(rng, 3) + item[third : 2 * third], 2: item[: len(item) // 4]}[i // 3 % 3]
            at = rng.randrange(len(text))
            text = text[:at] + piece + text[at:]
        docs.append((i, text))
    return docs, items


def test_join_against_brute_force(spark):
    docs, items = corpus()
    want = set()
    for i, t in docs:
        for k, x in items:
            tiles = D.tile(one_text_words(" ".join(t)), one_text_words(" ".join(x)), D.SEED)
            if sum(n for *_, n in tiles) >= D.COVERAGE * len(x):
                want.add((i, k))
    d = odd.plain(spark, [(i, " ".join(t)) for i, t in docs])
    b = spark.createDataFrame([(k, " ".join(x), "z") for k, x in items], ITEMS)
    sent = D.contamination(d, b)
    assert {(r.doc_id, r.item_id) for r in sent.collect()} == want and len(want) >= 12
    assert sorted(sent.collect()) == sorted(D.contamination(d, b, sent_words=0).collect())
    assert {r.doc_id for r in D.decontaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_odd_documents(spark):
    docs = odd.documents(spark)
    b = spark.createDataFrame([(1, "lazy dog and runs away the quick brown fox", "x"), (2, None, "x"), (None, "word", "x"), (3, "", "x"), (4, "...", "x"), (5, "word", "x"), (5, "word", "x"), (6, " ".join(f"word{i} and more" for i in range(8000, 9000)), "x")], ITEMS)
    for sent in (10**6, 0):
        got = {(r.doc_id, r.item_id) for r in D.contamination(docs, b, sent_words=sent).collect()}
        assert got == {(1, 1), (2, 1), (8, 5), (6, 6)}
    assert sorted(map(str, D.decontaminated(docs, b).collect())) == sorted(map(str, D.decontaminated(docs, b, sent_words=0).collect()))
    kept = D.decontaminated(docs, b)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 4, 5, 7, 9]
    assert D.contamination(docs.limit(0), b).count() == 0 and D.contamination(docs, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.contamination(docs, b, 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: one_text_words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: one_text_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for i, d in docs.items():
        for k, x in items.items():
            if len(x) and len(np.intersect1d(d, x)):
                n = sum(t[2] for t in D.tile(d, x, D.SEED))
                if n >= D.COVERAGE * len(x):
                    want.add((i, k, n))
    assert {(r.doc_id, r.item_id, r.matched) for r in D.op7_decontamination(spark, sf).collect()} == want and want
