"""What the training-data operators share: session folders, Arrow text batches
and vectorised word hashing.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text.  Word and n-gram hashes are 64-bit.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; it bounds a worker's memory.
SLICE_BYTES = (1 << 19) - 1
#: Rows and bytes handed to a Python worker at once, at most (or one row).
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a
    temporary folder when the setting is missing.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plumbob-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``work_path`` that is no longer needed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: texts may be long and workers' memory is not.

    The two settings stay with the session, as plans run after this returns;
    other queries of the session get such batches, too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def key_text(docs: DataFrame, null_texts: bool = False) -> DataFrame:
    """``(doc_id BIGINT, text STRING)`` without rows that lack either; with
    ``null_texts``, without those that lack an id."""
    require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows if null_texts else rows.where("text IS NOT NULL")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# --------------------------------------------------------------- word hashing

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.empty(m, dtype=np.uint64)
            t[0], done = 1, 1
            while done < m:  # doubling: t[done:2*done] = t[:done] * base**done
                t[done : 2 * done] = t[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            tables.append(t)
        _powers[:] = tables
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data`` (UTF-8).

    ``bounds`` has each text's first byte and the last one's end.  Returns the
    hashes and, like ``bounds``, where each text's words begin among them.
    """
    inside = _WORD[data]
    if not len(data) or not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    ends[cuts - 1] = inside[cuts - 1]
    at, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
    return hashes, np.searchsorted(at, bounds)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(_BASE) + words[k : k + m]
    return mix(h + np.uint64(n))


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of a text's n-grams; a text of fewer than ``n`` words has
    all its words as one gram, one without words has none."""
    if 0 < len(words) < n:
        return gram_hashes(words, len(words))
    return np.unique(gram_hashes(words, n))


def lowered(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(texts.cast(pa.large_string()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a ``large_string`` array."""
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def slices(offsets: np.ndarray):
    """Runs of rows of about SLICE_BYTES each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j
        i = j


def each_words(texts: pa.Array):
    """``(row, word hashes)`` of each text; a null counts as empty."""
    low = pc.fill_null(lowered(texts), "")
    data, offsets = buffers(low)
    for i, j in slices(offsets):
        lo, hi = offsets[i], offsets[j]
        hashes, where = word_hashes(data[lo:hi], offsets[i : j + 1] - lo)
        for r in range(i, j):
            yield r, hashes[where[r - i] : where[r - i + 1]]


def one_text_words(text: str | None) -> np.ndarray:
    return next(each_words(pa.array([text or ""])))[1]


def trim() -> None:
    """Give a worker's free memory back to the machine, at a task's end."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))


# --------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of each node of ``edges(a, b)``; the root is the smallest
    node that it is connected with.

    Alternates large-star and small-star steps, so paths shrink by a constant
    factor a round; each round is checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = small.where("a <> b").distinct().checkpoint()
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            break
        mark = seen
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
