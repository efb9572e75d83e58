"""Operator 6 - document fingerprints by MinHash.

Each text's set of word n-gram hashes is permuted by ``BANDS * ROWS``
universal hash functions ``(a*x + b) mod 2**64`` (a odd, seeded; the upper 32
bits count), all at once in numpy; the minima are the fingerprint.  ROWS minima
make one band; bands are joined in Spark and every pair that shares one is
compared on whole sets, so the result has no false pairs.  At the threshold of
0.6 a pair shares a band with a probability of 0.99.

Null ids and texts have no fingerprint; a text without words has a fingerprint
of null values and is similar to nothing; texts of fewer than n words are one
gram.  Very long texts are permuted whole, a thousand grams at a time.  Columns
other than ``doc_id`` and ``text`` aren't read.  See ``similarity`` for the
plan, the result's form, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbob.llm.common import each_words, gram_set, key_text, list_array, mix, table, tuned
from plumbob.llm.similarity import linked, oracle, similar_classes

N = 3
THRESHOLD = 0.6
BANDS, ROWS = 32, 4
SEED = 20240131


def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation."""
    low = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(grams), 1024):  # keeps the product in the cache
        np.minimum(low, (grams[i : i + 1024, None] * a + b).min(0), out=low)
    return low >> np.uint64(32)


def signer(bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
    a, b = permutations(bands * rows, seed)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(grams: np.ndarray) -> np.ndarray:
        h = salt
        for column in minima(grams, a, b).reshape(bands, rows).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h

    return sign


def fingerprints(docs: DataFrame, n: int = N, count: int = BANDS * ROWS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint ARRAY<BIGINT>)``, one row for each input row that
    has an id and a text."""
    a, b = permutations(count, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [minima(gram_set(w, n), a, b).astype(np.int64) if len(w) else np.zeros(0, np.int64) for _, w in each_words(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(rows, pa.int64())], ["doc_id", "fingerprint"])

    tuned(docs.sparkSession)
    return key_text(docs).mapInArrow(run, "doc_id long, fingerprint array<long>")


def fingerprint_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """``(doc_id, class_id, links)`` of all documents; see ``similarity.linked``."""
    return linked(docs, n, threshold, signer(bands, rows, seed))


def fingerprint_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The join as pairs between classes of equal sets, and their members; see
    ``similarity.similar_classes``."""
    return similar_classes(docs, n, threshold, signer(bands, rows, seed))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_join(table(spark, sf_dir, "documents"))


ORACLE = oracle("CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END", THRESHOLD)
