"""Operator 7 - benchmark decontamination by greedy string tiling.

Texts and benchmark items are words (see ``common``).  Runs of ``SEED`` words
that a text shares with an item nominate the pair; then, in the manner of
running Karp-Rabin with greedy string tiling, the pair's longest common runs
are marked, longest first and never overlapping in either, down to ``SEED``
words.  The tiles' share of the item's words is the coverage, so an item whose
sentences come in another order is found as well as one copied whole.

Each text's seeds are hashed in numpy and looked up in the items' seeds.  Up
to ``SENT_WORDS`` words of benchmark, the items are sent to the tasks and the
texts never leave theirs; beyond it, seeds are joined by a shuffle and only
texts that share one are sent to where their items are.

Null ids or texts, in either table, take no part; an item of fewer than SEED
words is found if a text has all its words in a row; one without words is
never found.  Repeated items or documents each have their rows, without
repetition of equal rows.  Texts and items are compared whole, however long;
columns other than ids and texts aren't read, whatever their names; an empty
table on either side gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import each_words, gram_hashes, key_text, one_text_words, require, table, tuned

SEED = 5
COVERAGE = 0.5
SENT_WORDS = 2_000_000

SCHEMA = "doc_id long, item_id long, coverage double, matched int, tiles int"


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(doc position, item position, length)`` of word hashes.

    Ties are broken by the positions in the item, then in the document.
    """
    least = max(1, min(least, len(item)))
    d, p = gram_hashes(doc, least), gram_hashes(item, least)
    if not len(d) or not len(p):
        return []
    starts = defaultdict(list)
    for i, h in enumerate(p.tolist()):
        starts[h].append(i)
    hits = [(i, j) for j in np.flatnonzero(np.isin(d, p)).tolist() for i in starts[d[j].item()]]
    # Seeds that follow each other on a diagonal are one run.
    runs, diagonal = [], {}
    for i, j in hits:
        r = diagonal.get(j - i)
        if r is not None and r[0] + r[2] - least + 1 == i:
            r[2] += 1
        else:
            r = diagonal[j - i] = [i, j, least]
            runs.append(r)
    free_d, free_p = np.ones(len(doc), bool), np.ones(len(item), bool)
    buckets = defaultdict(list)
    for i, j, n in runs:
        buckets[n].append((i, j))
    tiles = []
    while buckets:
        n = max(buckets)
        for i, j in sorted(buckets.pop(n)):
            open_ = free_p[i : i + n] & free_d[j : j + n]
            if open_.all():
                free_p[i : i + n] = free_d[j : j + n] = False
                tiles.append((j, i, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2], edge[1::2]):  # what is left of the run waits for its turn
                if b - a >= least:
                    buckets[b - a].append((i + a, j + a))
    return tiles


class Items:
    """Benchmark items by their seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.ids, self.words = least, [], []
        seeds = defaultdict(list)
        for item_id, text in rows:
            words = one_text_words(text)
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            n = min(least, len(words))
            for h in np.unique(gram_hashes(words, n)):
                seeds[n].append((h, k))
        self.seeds = {}
        for n, pairs in seeds.items():
            pairs.sort()
            self.seeds[n] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])

    def match(self, words: np.ndarray, coverage: float):
        """``(item_id, coverage, matched words, tiles)`` of the items found."""
        near: set[int] = set()
        for n, (h, k) in self.seeds.items():
            g = gram_hashes(words, n)
            if len(g):
                at = np.searchsorted(h, g)
                hit = np.unique(g[h[np.minimum(at, len(h) - 1)] == g])
                for lo, hi in zip(np.searchsorted(h, hit), np.searchsorted(h, hit, side="right")):
                    near.update(k[lo:hi].tolist())
        for k in sorted(near):
            tiles = tile(words, self.words[k], self.least)
            matched = sum(t[2] for t in tiles)
            if matched >= coverage * len(self.words[k]):
                yield self.ids[k], matched / len(self.words[k]), matched, len(tiles)


def _match_all(items: Items, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").to_numpy(zero_copy_only=False)
            rows = [(keys[r], *m) for r, words in each_words(b.column("text")) for m in items.match(words, coverage)]
            yield _found(rows)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "coverage": pa.float64(), "matched": pa.int32(), "tiles": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _lengths(least: int):
    """The seeds' lengths that items have: up to ``least`` different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {min(least, len(words)) for b in batches for _, words in each_words(b.column("text")) if len(words)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["n"])

    return run


def _seeds(key: str, least: int, lengths: list[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, seeds = [], []
            keys = b.column(key).to_numpy(zero_copy_only=False)
            for r, words in each_words(b.column("text")):
                for n in lengths if lengths is not None else [min(least, len(words))]:
                    g = np.unique(gram_hashes(words, n)) if n else np.zeros(0, np.uint64)
                    seeds.append(g.view(np.int64))
                    ids.append(np.full(len(g), keys[r], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or [np.zeros(0, np.int64)])), pa.array(np.concatenate(seeds or [np.zeros(0, np.int64)]))], [key, "seed"])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    require(benchmark, "item_id", "text")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()


def _fits(items: DataFrame, words: int) -> bool:
    """Whether the items can be sent to the tasks: about four characters a word."""
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= 4 * words


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED, sent_words: int = SENT_WORDS) -> DataFrame:
    """``(doc_id, item_id, coverage, matched, tiles)`` of the items that texts
    cover by ``coverage`` at least."""
    if not 0 < coverage <= 1 or least < 1:
        raise ValueError("0 < coverage <= 1 and least >= 1")
    tuned(docs.sparkSession)
    texts = key_text(docs)
    items = _items(benchmark)
    if _fits(items, sent_words):
        known = Items([(r.item_id, r.text) for r in items.collect()], least)
        return texts.mapInArrow(_match_all(known, coverage), SCHEMA).distinct()
    lengths = [r.n for r in items.mapInArrow(_lengths(least), "n int").distinct().collect()]
    a = texts.mapInArrow(_seeds("doc_id", least, lengths), "doc_id long, seed long")
    b = items.mapInArrow(_seeds("item_id", least), "item_id long, seed long")
    near = a.join(b, "seed").select("doc_id", "item_id").distinct()
    pairs = near.join(texts, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")))
            yield _found([(d, i, *m[1:]) for d, i, t, x in rows for m in Items([(i, x)], least).match(one_text_words(t), coverage)])

    return pairs.mapInArrow(run, SCHEMA).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED, sent_words: int = SENT_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns.

    Each row is judged by its own text; rows with a null id or text stay.  Where
    the items can be sent to the tasks, no row is shuffled.  Beyond that texts
    are known by 64-bit hashes: a clean text goes with a leaking one of the same
    hash, once in 2**64 pairs.
    """
    require(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    items = _items(benchmark)
    if _fits(items, sent_words):
        known = Items([(r.item_id, r.text) for r in items.collect()], least)

        @F.arrow_udf("boolean")
        def leaks(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for r, words in each_words(texts):
                out[r] = next(known.match(words, coverage), None) is not None
            return pa.array(out)

        tuned(docs.sparkSession)
        return docs.where(F.col("doc_id").isNull() | ~leaks(text))
    same = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")).where("text IS NOT NULL")
    found = contamination(same, benchmark, coverage, least, sent_words).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].isNotNull() & docs["text"].isNotNull() & (F.xxhash64(docs["text"].cast("string")) == found["_leaked"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
