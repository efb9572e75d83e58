import random

import numpy as np
import pytest

import odd
from plumbob.llm import pieces as P

TEXTS = ["", "a", " ", "   ", "\n", "Hello world", " lead and trail ", "two  spaces   three", "newline\nand\ttab\r\n", "x" * 3000, "日本語のテキスト 漢字", "emoji 😀😃 \u0000 �", "▁ the mark itself ▁▁", "aaaa" * 300, "don't stop!!! ### %%% $$$", "1234567890" * 50, "мир труд май", "é combining"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(P.MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def noise(rng, n):
    return "".join(rng.choices("ab cdeéñ th 中文 \n\t1239#%|▁.,", k=n))


def test_whole_texts_are_the_library_s(vocabulary, library):
    rng = random.Random(1)
    texts = TEXTS + [noise(rng, rng.randint(0, 400)) for _ in range(300)]
    seg = P.Segmenter(vocabulary)
    flat, sizes = seg.encode_all(texts)
    ends = np.append(0, np.cumsum(sizes))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert flat[a:b].tolist() == library.encode(t), t[:40]


@pytest.mark.parametrize("chunk", [1, 3, 17, 100, 1000])
def test_chunks_are_the_whole(vocabulary, library, chunk):
    rng = random.Random(chunk)
    seg = P.Segmenter(vocabulary)
    for t in [t for t in TEXTS if t] + [noise(rng, rng.randint(1, 300)) for _ in range(60)]:
        assert P.encode_by_chunks(t, seg, chunk).tolist() == library.encode(t), t[:40]


def test_merges_and_lattice_agree(vocabulary):
    rng = random.Random(5)
    seg = P.Segmenter(vocabulary)
    words = [P.SPACE + noise(rng, rng.randint(1, 40)).replace(" ", "").replace(P.SPACE, "x") for _ in range(500)]
    flat, sizes = seg.segment(words)
    ends = np.append(0, np.cumsum(sizes))
    assert [tuple(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])] == [seg.word(w) for w in words]


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((a, b)) < 0.5, rng.normal(size=(a, b)), P.LOW) for a, b in [(1, 4), (4, 3), (3, 5), (5, 2), (2, 3)]]
    left = [ms[0]]
    for m in ms[1:]:
        left.append(P.max_plus(left[-1], m))
    for a, b in zip(P.scan(ms), left):
        assert np.allclose(a, b) or ((a == b) | np.isclose(a, b)).all()


def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    class Unigram(sentencepiece.SentencePieceProcessor):
        def get_score(self, i):
            return -i / 7

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError):
        P.Vocabulary(P.MODEL)


def test_memo_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(P, "MEMO", 20)
    rng, seg = random.Random(2), P.Segmenter(vocabulary)
    for _ in range(50):
        t = noise(rng, 200)
        assert seg.encode(t).tolist() == library.encode(t)


def test_odd_documents(spark, library):
    docs = odd.documents(spark)
    for chunk in (P.CHUNK, 1000):
        got = P.encode(docs, chunk=chunk).collect()
        assert len(got) == docs.count()
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        by = {}
        for i, t in texts:
            by.setdefault(i, []).append(None if t is None else library.encode(t))
        for r in got:
            assert r.token_ids in by[r.doc_id]
            assert r.token_ids is None or r.restored and r.n_tokens == len(r.token_ids)
    assert P.encode(docs.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in P.decode(P.encode(docs.where("doc_id IS NOT NULL"))).collect()}
    assert back == {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op9_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts) and all(r.restored and r.token_ids == library.encode(texts[r.doc_id]) for r in got)
