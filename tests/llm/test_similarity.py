"""N-gram Jaccard join and fingerprints against brute force."""

import math
import random

import numpy as np
import pytest

import compare
import odd
from plumbob.llm import fingerprints, ngram_jaccard, registry, similarity
from plumbob.llm.common import components, gram_set, one_text_words

SF = "/root/testdata/sf0.001"


def corpus(seed, n=60, words=(5, 400)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    out = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randint(*words))
        out.append((10 * i, " ".join(text)))
        for k in range(rng.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.05, 0.1, 0.3]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((10 * i + k + 1, " ".join(copy)))
    return out


def brute(rows, n, threshold):
    sets = {i: set(gram_set(one_text_words(t), n).tolist()) for i, t in rows if len(one_text_words(t))}
    ids = sorted(sets)
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def pairs(found):
    """Pairs of documents of (pairs between classes, membership)."""
    between, member = found
    ids = {}
    for r in member.collect():
        if r.set_id is not None:
            ids.setdefault(r.set_id, []).append(r.doc_id)
    out = {(x, y): 1.0 for m in ids.values() for x in m for y in m if x < y}
    for r in between.collect():
        assert r.a < r.b and min(ids[r.set_a]) == r.a and min(ids[r.set_b]) == r.b
        for a in ids[r.set_a]:
            for b in ids[r.set_b]:
                assert (min(a, b), max(a, b)) not in out  # each once
                out[min(a, b), max(a, b)] = round(r.jaccard, 9)
    return out


def rows_of(want, ids):
    """``(doc_id, class_id, links)`` by brute force, from the pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = dict.fromkeys(ids, 0)
    for p in want:
        for i in p:
            links[i] += 1
    return {(i, find(i), links[i]) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = odd.plain(spark, rows)
    for join, rows_join, n, t in ((ngram_jaccard.ngram_jaccard_pairs, ngram_jaccard.ngram_jaccard_join, 2, 0.7), (fingerprints.fingerprint_pairs, fingerprints.fingerprint_join, 3, 0.6)):
        want, got = brute(rows, n, t), pairs(join(docs))
        assert got.items() <= want.items()
        assert len(got) >= 0.95 * len(want) > 20
        assert {tuple(r) for r in rows_join(docs).collect()} == rows_of(got, [i for i, _ in rows])


def test_small_bands_are_exact(spark):
    rows = corpus(5, 80, (3, 30))
    want = brute(rows, 1, 0.8)
    assert pairs(ngram_jaccard.ngram_jaccard_pairs(odd.plain(spark, rows), 1, 0.8)) == want
    assert {tuple(r) for r in ngram_jaccard.ngram_jaccard_join(odd.plain(spark, rows), 1, 0.8).collect()} == rows_of(want, [i for i, _ in rows])


def test_one_word_edits_of_short_texts(spark):
    rng, rows = random.Random(21), []
    for i in range(600):
        words = [f"w{rng.randrange(5000)}" for _ in range(3 + i % 10)]
        at, other = rng.randrange(len(words)), f"x{i}"
        edited = (words + [other], words[:-1] + [other], words[1:], words[:at] + [other] + words[at + 1 :])[rng.randrange(4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    want = brute(rows, 2, 0.7)
    assert pairs(ngram_jaccard.ngram_jaccard_pairs(odd.plain(spark, rows))) == want and len(want) > 200


def least_pairs(threshold, most):
    """Sizes in common and alone of the pairs at the threshold, one for each
    two sizes up to ``most``."""
    for a in range(1, most + 1):
        for b in range(a, most + 1):
            both = math.ceil(threshold * (a + b) / (1 + threshold) - 1e-9)
            exact = b <= ngram_jaccard.SMALL or ngram_jaccard.instance(ngram_jaccard.band_of(b, threshold), threshold)[1] == 3
            if both <= a and (a, b) != (both, both) and exact:
                yield both, a - both, b - both


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.85])
def test_sets_of_exact_bands_share_a_signature(threshold):
    """Every kind of pair at the threshold, up to 40 features."""
    rng, sign = np.random.default_rng(1), ngram_jaccard.signer(threshold)
    kinds = list(least_pairs(threshold, 40))
    assert len(kinds) > 60
    for both, only_a, only_b in kinds:
        for _ in range(40 if both <= 12 else 4):
            x = rng.integers(0, 1 << 63, both + only_a + only_b, dtype=np.uint64)
            assert len(np.intersect1d(sign(x[: both + only_a]), sign(np.delete(x, np.s_[both : both + only_a]))))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.7, 0.85])
def test_larger_sets_share_a_signature(threshold):
    """Pairs at the threshold, whatever their sizes and the order of features."""
    rng = np.random.default_rng(7)
    signs = ngram_jaccard.signer(threshold), ngram_jaccard.signer(threshold, rng.integers(0, 9, 1 << ngram_jaccard.COUNTER_BITS).astype(np.uint8))
    for both in (9, 24, 50, 58, 81, 170, 700):
        alone = int(both / threshold + 1e-9) - both
        for only_a in (0, alone // 4, alone // 2):
            for _ in range(60):
                x = rng.integers(0, 1 << 63, both + alone, dtype=np.uint64)
                a, b = x[: both + only_a], np.delete(x, np.s_[both : both + only_a])
                assert all(len(np.intersect1d(sign(a), sign(b))) for sign in signs)
                assert len(np.intersect1d(ngram_jaccard.runs(a, threshold), ngram_jaccard.runs(b, threshold)))


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9])
def test_sketches_part_no_similar_sets(threshold):
    rng = np.random.default_rng(8)
    for size in (3, 60, 64, 65, 400):
        both = rng.integers(0, 1 << 63, (30, size), dtype=np.uint64)
        alone = int(size / threshold + 1e-9) - size
        sets = [np.concatenate([x, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for x in both for k in (0, alone)]
        to = similarity.parted(list(range(60)), [len(x) for x in sets], [similarity.sketch(x) for x in sets], threshold)
        assert all(a == b for a, b in zip(to[::2], to[1::2]))
        assert size < 400 or threshold < 0.7 or to[::2] == list(range(0, 60, 2))


def test_parts_over_many_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(4)]
    rows = [(7, 1, 0), (7, 2, 1), (7, 3, 0), (8, 4, 1), (8, 5, 2), (9, 6, 3), (9, 4, 1), (9, 1, 0), (9, 3, 0), (9, 9, 3), (11, 2, 1)]
    batch = pa.table({"block": [r[0] for r in rows], "set_id": [r[1] for r in rows], "size": [300] * len(rows), "sketch": [similarity.sketch(sets[r[2]]) for r in rows]})
    for most, want in ((256, {(1, 1), (1, 3), (6, 6), (6, 9)}), (4, {(1, 1), (1, 3), *((9, x) for x in (1, 3, 4, 6, 9))})):
        monkeypatch.setattr(similarity, "SKETCHED_SETS", most)
        for size in (1, 2, 5, 11):
            out = similarity._parts(0.7)(iter(batch.to_batches(size)))
            assert {p for o in out for p in zip(o.column(0).to_pylist(), o.column(1).to_pylist())} == want


def continued(count):
    """Texts of 50 bigrams, and the same with 21 more: a similarity of 50/71."""
    words = [[f"w{i}x{k}" for k in range(72)] for i in range(count)]
    return [(2 * i + k, " ".join(w[: 51 + 21 * k])) for i, w in enumerate(words) for k in (0, 1)]


def test_no_link_of_larger_texts_is_lost(spark):
    rows = continued(800)
    assert {tuple(r) for r in ngram_jaccard.ngram_jaccard_join(odd.plain(spark, rows)).collect()} == {(i, i - i % 2, 1) for i, _ in rows}
    rows = corpus(11, 80)
    assert pairs(ngram_jaccard.ngram_jaccard_pairs(odd.plain(spark, rows))) == brute(rows, 2, 0.7)


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op6_fingerprints"])
def test_sql(spark, name):
    assert compare.differences(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


def test_odd_documents(spark):
    docs = odd.documents(spark)
    for join, between in ((ngram_jaccard.ngram_jaccard_join, ngram_jaccard.ngram_jaccard_pairs), (fingerprints.fingerprint_join, fingerprints.fingerprint_pairs)):
        assert pairs(between(docs)) == {(1, 2): 1.0}
        assert sorted(tuple(r) for r in join(docs).collect()) == [(1, 1, 1), (2, 1, 1), *((i, i, 0) for i in range(3, 10))]
        assert join(docs.limit(0)).count() == 0 and pairs(between(docs.limit(0))) == {}
    assert [r.doc_id for r in ngram_jaccard.near_copies(docs).collect()] == [2]
    kept = ngram_jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert ngram_jaccard.deduplicated(docs.limit(0)).count() == 0
    prints = fingerprints.fingerprints(docs).collect()
    assert len(prints) == 9 and {len(r.fingerprint) for r in prints if r.doc_id not in (4, 5)} == {128}


def test_one_id_with_several_texts(spark):
    """Each of an id's texts has its own row and loses no link."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(20)) for c in "xyz")
    rows = [(1, x), (1, y), (5, y), (9, x + " end"), (7, z), (5, y)]
    got = sorted(tuple(r) for r in ngram_jaccard.ngram_jaccard_join(odd.plain(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (7, 7, 0), (9, 1, 1)]


def test_shuffled_way_and_cut_blocks_are_the_same(spark, monkeypatch):
    rows = corpus(3, 30)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows += [(1000 + i, " ".join(w if k != i % 24 else f"v{i}" for k, w in enumerate(base))) for i in range(40)]
    docs = odd.plain(spark, rows)
    want = pairs(ngram_jaccard.ngram_jaccard_pairs(docs))
    links = sorted(tuple(r) for r in ngram_jaccard.ngram_jaccard_join(docs).collect())
    assert len(want) > 700
    gone = sorted(r.doc_id for r in ngram_jaccard.deduplicated(docs).collect())
    monkeypatch.setattr(similarity, "SENT_IDS", 0)
    monkeypatch.setattr(ngram_jaccard, "SENT_IDS", 0)
    monkeypatch.setattr(similarity, "PART_GRAMS", 90)
    assert pairs(ngram_jaccard.ngram_jaccard_pairs(docs)) == want
    monkeypatch.setattr(similarity, "PART_SETS", 7)
    assert sorted(tuple(r) for r in ngram_jaccard.ngram_jaccard_join(docs).collect()) == links
    assert sorted(r.doc_id for r in ngram_jaccard.deduplicated(docs).collect()) == gone


def test_many_copies_leave_one(spark):
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(500)], k=200)
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    gone = {r.doc_id for r in ngram_jaccard.near_copies(odd.plain(spark, rows)).collect()}
    assert gone == set(range(1, 300))


def test_links_over_many_batches():
    import pyarrow as pa

    sig = np.repeat(np.arange(5), [1, 4, 1, 7, 2])
    sets = np.concatenate([[5], [1, 2, 2, 9], [4], range(7), [3, 3]]).astype(np.int64)
    whole = set()
    for size in (1, 2, 3, 15):
        batches = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + size]), pa.array(sets[i : i + size])], ["sig", "set_id"]) for i in range(0, 15, size)]
        got = {(a, b) for out in similarity._links(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        whole = whole or got
        assert got == whole == {(1, 1), (1, 2), (1, 9), *((0, k) for k in range(7))}


def test_rows_of_signatures_take_eight_bytes():
    import pyarrow as pa

    texts = [f"w{i} " * 3 + " ".join(f"w{(i * k) % 97}" for k in range(90)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc_id", "text"])
    sign = ngram_jaccard.signer(0.7)
    sets = {similarity.set_id(g): sign(g) for g in (gram_set(one_text_words(t), 2) for t in texts)}
    bucket = {}
    for own, sigs in sets.items():
        for s in sigs.tolist():
            bucket.setdefault(s, set()).add(own & 0xFFFFFFFF)
    want = {(min(b), x) for b in bucket.values() if len(b) > 1 for x in b}
    for parts in (1, 7, 600):  # a shuffle of more parts sends no more bytes
        rows = list(similarity._signatures(2, sign, parts)(iter([batch, batch])))
        assert sum(len(x) for b in rows for x in b.column(1).to_pylist()) == 8 * sum(map(len, sets.values()))
        found = similarity._links(similarity._sorted_rows(iter(rows)))
        assert {(a, b) for out in found for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}


def test_bad_arguments(spark):
    for n, t in ((0, 0.5), (2, 0.0), (2, 1.5)):
        with pytest.raises(ValueError):
            ngram_jaccard.ngram_jaccard_join(odd.plain(spark, []), n, t)
    with pytest.raises(ValueError):
        ngram_jaccard.near_copies(spark.range(3))


@pytest.mark.parametrize("dense", [2_000_000, 900, 0])
def test_compare_is_exact(monkeypatch, dense):
    """Products and lists of sets, within a part and across, by definition."""
    monkeypatch.setattr(similarity, "DENSE", dense)
    rng = np.random.default_rng(dense)
    for n, size, features in ((2, 5, 8), (40, 6, 40), (120, 30, 300), (90, 40, 45)):
        base = rng.integers(0, features, size)
        sets = [np.unique(np.concatenate([base[rng.random(size) > 0.15], rng.integers(0, features, 3)])).astype(np.uint64) for _ in range(n)]
        for left in (None, rng.random(n) < 0.4, np.zeros(n, bool)):
            a, b, j = similarity.compare(sets, 0.7, left)
            got = {(min(x, y), max(x, y)): round(s, 12) for x, y, s in zip(a.tolist(), b.tolist(), j.tolist())}
            held = [set(s.tolist()) for s in sets]
            want = {(x, y): round(len(held[x] & held[y]) / len(held[x] | held[y]), 12) for x in range(n) for y in range(x + 1, n) if (left is None or left[x] != left[y]) and len(held[x] & held[y]) >= 0.7 * len(held[x] | held[y])}
            assert got == want and len(a) == len(got)
