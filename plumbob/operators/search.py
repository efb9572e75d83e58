"""Exact search: top-k of one query, of many queries, recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbob.errors import ValidationError
from plumbob.functions.vectors import Metric, literal

MOST_K = 10_000
#: Queries, and vectors, of one numpy product; together they bound a worker's
#: memory.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Up to so many numbers the queries are sent to the tasks that hold vectors
#: (4 or 8 bytes each); beyond it both sides meet in blocks.
SENT_NUMBERS = 16_000_000
#: Numbers of a block of queries, and of vectors, that a task holds.
ASKED_NUMBERS, HELD_NUMBERS = 4_000_000, 8_000_000
#: Candidates that wait until the best of them are kept.
PENDING = 200_000
#: The largest collection that is searched exactly by default.
EXACT_ROWS = 10_000


def checked_k(k: int) -> int:
    if not 1 <= k <= MOST_K:
        raise ValidationError(f"k must be between 1 and {MOST_K}")
    return k


def checked_query(vector, dim: int | None = None, metric: Metric = Metric.COSINE) -> np.ndarray:
    q = np.asarray(vector, float)
    if q.ndim != 1 or not len(q) or dim is not None and len(q) != dim:
        raise ValidationError(f"dimension {dim} expected, found {q.shape}")
    if not np.isfinite(q).all():
        raise ValidationError(f"element {int(np.flatnonzero(~np.isfinite(q))[0])} isn't finite")
    if metric is Metric.COSINE and not q.any():
        raise ValidationError("zero vector")
    return q


def scored(docs: DataFrame, query, metric: Metric | str, vector: str = "embedding") -> DataFrame:
    """``docs`` with the column ``score``; vectors of another length are left out."""
    metric = Metric.of(metric)
    q = checked_query(query, None, metric)
    return docs.where(F.size(vector) == len(q)).withColumn("score", metric.score(F.col(vector), literal(q)))


def top_k(docs: DataFrame, query, k: int, metric: Metric | str = Metric.COSINE, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), where=None) -> DataFrame:
    """``(key, score, *keep)`` of the k closest; ties by key.

    The plan ends in TakeOrderedAndProject: a task sends k rows.
    ``where`` filters first.
    """
    checked_k(k)
    metric = Metric.of(metric)
    rows = scored(docs if where is None else docs.where(where), query, metric, vector)
    order = F.asc("score") if metric.ascending else F.desc("score")
    return rows.select(key, "score", *keep).orderBy(order, F.asc(key)).limit(k)


def responses(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """What a search answers to a client: ``(doc_id, external_id, distance)``;
    the field called distance holds the score."""
    external = F.col("external_id") if "external_id" in found.columns else F.lit(None).cast("string").alias("external_id")
    return found.select(F.col(key).cast("string").alias("doc_id"), external, F.col("score").alias("distance"))


class Best:
    """The k closest vectors of each query so far; ties by position.  Pairs come
    in any order, and again if ``repeats``; what is held doesn't grow with them."""

    def __init__(self, base: int, queries: int, k: int, repeats: bool = False):
        self.base, self.k, self.repeats = base, k, repeats  # queries from base on
        self.cut = np.full(queries, -np.inf)  # closeness of the k-th
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.pending = 0

    def add(self, who: np.ndarray, which: np.ndarray, close: np.ndarray) -> None:
        if len(who):
            self.parts.append((who, which, close))
            self.pending += len(who)
            if self.pending > PENDING:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            who, which, close = (np.concatenate(c) for c in zip(*self.parts))
            order = np.lexsort((which, -close, who))
            who, which, close = who[order], which[order], close[order]
            if self.repeats:  # of equal scores, and so side by side
                new = np.append(True, (who[1:] != who[:-1]) | (which[1:] != which[:-1]))
                who, which, close = who[new], which[new], close[new]
            begins = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            nth = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
            last = nth == self.k - 1
            self.cut[who[last]] = close[last]
            keep = nth < self.k
            self.parts, self.pending = [(who[keep], which[keep], close[keep])], 0
        return self.parts[0]


class Points:
    """Vectors, how they are scored, and what tells quickly which are near."""

    def __init__(self, x: np.ndarray, metric: Metric):
        self.metric, x = metric, np.asarray(x)
        if metric is Metric.COSINE:
            x = x.astype(float)
            norm = np.linalg.norm(x, axis=1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.nan_to_num(x / norm)
        self.exact = x
        self.norm = np.linalg.norm(x.astype(float), axis=1)
        some = self.norm[self.norm > 0]
        #: whether half the digits do for a first look
        self.short = not len(some) or bool(some.min() > 1e-12 and some.max() < 1e12)

    def __len__(self) -> int:
        return len(self.exact)


def _measured(q: Points, a: np.ndarray, v: Points, b: np.ndarray) -> np.ndarray:
    """Closeness (larger is closer) of pairs; the same wherever they are met."""
    out = np.empty(len(a))
    step = max(1, 2_000_000 // max(1, q.exact.shape[1]))
    for i in range(0, len(a), step):
        x, y = q.exact[a[i : i + step]].astype(float), v.exact[b[i : i + step]].astype(float)
        out[i : i + step] = -np.linalg.norm(x - y, axis=1) if q.metric is Metric.L2 else np.einsum("ij,ij->i", x, y)
    return out


def compare(best: Best, q: Points, v: Points, who: np.ndarray, lo: int, hi: int, place: np.ndarray | None = None) -> None:
    """Offer the vectors from ``lo`` to ``hi`` to the queries ``who``; ``place``
    is what they are known by, else their positions.

    Products of single floats tell what may be near, with what they may be wrong
    by; that is measured in double.
    """
    kind = np.float32 if q.short and v.short else float
    x, k, dim = q.exact[who].astype(kind), best.k, q.exact.shape[1]
    small = np.finfo(kind).eps * (2 * dim + 16)
    at = who - best.base
    for i in range(lo, hi, VECTOR_BLOCK):
        j = min(hi, i + VECTOR_BLOCK)
        s = x @ v.exact[i:j].astype(kind).T
        far = v.norm[i:j].max(initial=0.0)
        slack = small * q.norm[who] * far
        if q.metric is Metric.L2:
            s *= 2
            s -= (v.norm[i:j] ** 2).astype(kind)
            slack = small * (q.norm[who] + far) ** 2
        cut = best.cut[at]
        if q.metric is Metric.L2:
            cut = np.where(np.isfinite(cut), q.norm[who] ** 2 - cut**2, -np.inf)
        if j - i > k:
            new = np.flatnonzero(cut == -np.inf)
            if len(new):  # at least k of this block are as near as its k-th
                cut[new] = np.partition(s[new], -k, axis=1)[:, -k] - slack[new]
        least = cut - slack
        a, b = np.nonzero(s >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None])
        best.add(at[a], b + i if place is None else place[b + i], _measured(q, who[a], v, b + i))
        if best.pending and j < hi:
            best.settle()


def closest(q: Points, v: Points, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and of their k closest vectors, and scores; ties by
    the vectors' positions."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    block = max(1, min(QUERY_BLOCK, QUERY_BLOCK * VECTOR_BLOCK // max(VECTOR_BLOCK, k)))
    for i in range(0, len(q), block):
        who = np.arange(i, min(len(q), i + block))
        best = Best(i, len(who), k)
        compare(best, q, v, who, 0, len(v))
        a, b, close = best.settle()
        parts.append((a + i, b, close))
    a, b, close = (np.concatenate(c) for c in zip(*parts))
    return a, b, -close if q.metric is Metric.L2 else close


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of its own type."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))


def numbers(df: DataFrame, vector: str) -> Column:
    """A vector column as it is sent: floats as they are, others as doubles."""
    kind = df.schema[vector].dataType.simpleString()
    return F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def _found(asked: pa.Table, held: pa.Table, k: int, metric: Metric) -> pa.Table:
    """``(query_id, doc_id, score)`` of the k closest; ties by doc_id."""
    held = held.sort_by("doc_id")
    a, b, score = closest(Points(matrix(asked.column("q")), metric), Points(matrix(held.column("v")), metric), k)
    return pa.table({"query_id": asked.column("query_id").combine_chunks().take(pa.array(a)), "doc_id": held.column("doc_id").combine_chunks().take(pa.array(b)), "score": pa.array(score)})


def top_k_batch(docs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", vector_of_queries: str | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the k closest to each query; ties
    by doc_id.  Vectors that are null or of another length are left out.

    Few queries are sent to the vectors, and each task's vectors, some thousands
    at a time, give their own k best.  Otherwise queries and vectors are cut into
    blocks and each pair of blocks meets in one task; either way scores are
    matrix products and only candidates are shuffled.
    """
    checked_k(k)
    metric = Metric.of(metric)
    asked = vector_of_queries or vector
    q = queries.where(F.col(asked).isNotNull()).select(F.col(query_key).alias("query_id"), numbers(queries, asked).alias("q"))
    size = q.agg(F.count("*").alias("n"), F.min(F.size("q")).alias("low"), F.max(F.size("q")).alias("d")).first()
    if size.low != size.d:
        raise ValidationError(f"queries of dimensions {size.low} to {size.d}")
    dim = size.d or 0
    v = docs.where(F.size(vector) == dim).select(F.col(key).alias("doc_id"), numbers(docs, vector).alias("v"))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {v.schema['doc_id'].dataType.simpleString()}, score double"
    rows = v.count()
    if (size.n or 0) * dim <= SENT_NUMBERS:
        sent = q.toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many = [], 0

            def found() -> list[pa.RecordBatch]:
                out = _found(sent, pa.Table.from_batches(held), k, metric)
                held.clear()
                return out.to_batches(max_chunksize=1 << 16)

            for b in batches:
                if b.num_rows and len(sent):
                    held.append(b)
                    many += b.num_rows * dim
                if many > HELD_NUMBERS:
                    yield from found()
                    many = 0
            if held:
                yield from found()

        # a file's one group of rows would be one task's work
        tasks = min(v.sparkSession.sparkContext.defaultParallelism, rows // VECTOR_BLOCK)
        near = (v.repartition(tasks) if tasks > 1 else v).mapInArrow(run, schema)
    else:
        qs, vs = max(1, -(-size.n * dim // ASKED_NUMBERS)), max(1, -(-rows * dim // HELD_NUMBERS))
        # each block of one side visits every block of the other
        a = q.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(vs - 1))))
        b = v.withColumn("j", F.pmod(F.xxhash64("doc_id"), F.lit(vs)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            if not len(x) or not len(y):
                return pa.table({"query_id": x.column("query_id").slice(0, 0), "doc_id": y.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
            return _found(x, y, k, metric)

        near = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(meet, schema)
    order = F.asc("score") if metric.ascending else F.desc("score")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.asc("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall)``: share of the exact k that was found."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("hit"))
    rows = exact.where(F.col("rank") <= k).join(hit, ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(k)).alias("recall"))


def index_choice(collections: DataFrame, rows: str = "rows") -> DataFrame:
    """``collections`` with ``index``: exact up to EXACT_ROWS, else ann."""
    return collections.withColumn("index", F.when(F.col(rows) <= EXACT_ROWS, "exact").otherwise("ann"))


def accesses(found: DataFrame, collection_id: str, at=None) -> DataFrame:
    """``(collection_id, accessed_at)``, a row for each query that was answered:
    what the tiers' statistics count."""
    when = F.current_timestamp() if at is None else at
    rows = found.select("query_id").distinct() if "query_id" in found.columns else found.limit(1)
    return rows.select(F.lit(collection_id).alias("collection_id"), when.alias("accessed_at"))
