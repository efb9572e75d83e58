"""Approximate search with exact scores: inverted cells and random hyperplanes.

Both give at most k rows for each query, scored exactly; what is approximate is
which vectors are looked at.  A preset names the recall that is wanted.  How
much has to be searched for it is measured on a bounded sample before the
search: clustered vectors need a few cells; nearly random ones need most of
them, and then the search is exact, which does less.

Both run the same join.  A vector lies in cells (one, or one for each hash
table), a query probes some; cells are gathered in groups of bounded size, and
in a group the queries of a cell meet its vectors as one matrix product.  Only
a group's k best of each query leave it.  Cells that hold more than
``PART_ROWS`` vectors are cut, so a hot one is spread over groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbob.errors import ValidationError
from plumbob.functions.vectors import Metric, closeness, normalized
from plumbob.operators.search import QUERY_BLOCK, Best, Points, checked_k, compare, matrix, numbers, top_k_batch

#: Vectors that the centres and probes are fitted on, at most (those of the
#: smallest hashes of their keys), and how many of them are taken as queries.
SAMPLE, ASKED = 20_000, 200
#: Numbers of a group's vectors, of the queries that meet them at once, and
#: vectors of an undivided cell.
GROUP_NUMBERS, ASKED_NUMBERS, PART_ROWS = 4_000_000, 16_000_000, 50_000
#: Numbers of the rows that a task makes of a batch at once.
SENT_NUMBERS = 1_000_000
MOST_CELLS, MOST_PROBES = 4096, 64
#: Beyond this share of the vectors exact search takes less time: the join spends
#: about eight times as long on a pair (106 against 27 s on 102,564 vectors).
EXACT_SHARE = 0.25


@dataclass(frozen=True)
class Cells:
    """``cells`` clusters (the square root of the rows, if none are given), of
    which a query searches ``probes``, or as many as ``recall`` takes."""

    cells: int | None = None
    probes: int | None = None
    recall: float = 0.95


@dataclass(frozen=True)
class Planes:
    """``tables`` hash tables of ``bits`` random hyperplanes each, of which a
    query searches ``probes`` buckets; where these aren't given, the longest
    keys and fewest probes that ``recall`` allows."""

    tables: int = 8
    bits: int | None = None
    probes: int | None = None
    recall: float = 0.95


CELLS = {"edge_cache": Cells(recall=0.85), "fast": Cells(recall=0.9), "balanced": Cells(), "high_recall": Cells(recall=0.99)}
PLANES = {"edge_cache": Planes(4, recall=0.85), "fast": Planes(recall=0.9), "balanced": Planes(), "high_recall": Planes(recall=0.99)}


def preset(name: str, kind: dict):
    if name not in kind:
        raise ValidationError(f"unknown preset: {name}")
    return kind[name]


def _points(vectors: pa.ChunkedArray | pa.Array, metric: Metric) -> np.ndarray:
    """Vectors as they are compared: for cosine with norm 1, but for zero ones."""
    x = _array(vectors)
    if metric is Metric.COSINE:
        norm = np.linalg.norm(x, axis=1)[:, None]
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x


def _array(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1 if len(vectors) else 0)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))


# --------------------------------------------------------------- which cells


class CellIndex:
    """Centres, and how many of the nearest ones a query probes."""

    tables = 1

    def __init__(self, centres: np.ndarray, probes: int, metric: Metric):
        self.centres, self.probes, self.metric = centres, min(probes, len(centres)), metric
        self.count = len(centres)

    def share(self) -> float:
        """About how much of the vectors a query is compared with."""
        return self.probes / self.count

    def order(self, q: np.ndarray) -> np.ndarray:
        """The cells of each query, best first."""
        product = q @ self.centres.T
        d = -product if self.metric is Metric.DOT else (self.centres * self.centres).sum(1) - 2 * product
        return np.argsort(d, axis=1, kind="stable")

    def cells(self, v: np.ndarray) -> np.ndarray:
        return ((self.centres * self.centres).sum(1) - 2 * v @ self.centres.T).argmin(1)[:, None]

    def probed(self, q: np.ndarray) -> np.ndarray:
        return self.order(q)[:, : self.probes]


class PlaneIndex:
    """Signs of projections as keys; a query probes, in each table, its own
    bucket and those that differ where its projections are smallest."""

    def __init__(self, planes: np.ndarray, tables: int, bits: int, probes: int):
        self.planes, self.tables, self.bits = planes[:, : tables * bits], tables, bits
        self.probes = min(probes, 1 << bits)
        self.count = tables << bits
        self.base = np.arange(tables) << bits

    def cells(self, v: np.ndarray) -> np.ndarray:
        sign = (v @ self.planes > 0).reshape(len(v), self.tables, self.bits)
        return sign @ (1 << np.arange(self.bits)) + self.base

    def share(self) -> float:
        return self.tables * self.probes / (1 << self.bits)

    def flips(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The bits to change in each query's keys, smallest projections first."""
        masks = np.arange(1 << self.bits)
        on = ((masks[:, None] >> np.arange(self.bits)) & 1).astype(float)
        if self.bits > 6:  # of longer keys at most three bits are changed
            few = on.sum(1) <= 3
            masks, on = masks[few], on[few]
        margin = np.abs(q @ self.planes).reshape(len(q), self.tables, self.bits)
        return masks[np.argsort(margin @ on.T, axis=2, kind="stable")[:, :, :probes]]

    def probed(self, q: np.ndarray) -> np.ndarray:
        own = self.cells(q) - self.base
        out = [np.zeros((0, self.tables * self.probes), np.int64)]
        for i in range(0, len(q), QUERY_BLOCK):
            part = slice(i, i + QUERY_BLOCK)
            out.append(((own[part, :, None] ^ self.flips(q[part], self.probes)) + self.base[:, None]).reshape(len(own[part]), -1))
        return np.concatenate(out)


def _sample(v: DataFrame, metric: Metric) -> np.ndarray:
    rows = v.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("v").toArrow().column("v")
    return _points(rows, metric)


def _truth(x: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sample as queries, and their nearest others in it."""
    asked = np.arange(min(ASKED, len(x)))
    s = closeness(x[asked], x, metric) * (-1 if metric is Metric.L2 else 1)
    s[asked, asked] = -np.inf
    return asked, np.argsort(-s, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]


def train_cells(x: np.ndarray, cells: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """Centres of k-means over a sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
        new = centres.copy()
        new[near[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def cell_index(x: np.ndarray, rows: int, k: int, metric: Metric, size: Cells) -> CellIndex:
    count = size.cells or min(MOST_CELLS, max(1, len(x) // 8), int(np.ceil(np.sqrt(rows))))
    index = CellIndex(train_cells(x, count), size.probes or 1, metric)
    if not size.probes:
        asked, near = _truth(x, k, metric)
        place = np.argsort(index.order(x[asked]), axis=1)  # where a cell comes in a query's order
        needed = np.sort(np.take_along_axis(place, index.cells(x)[:, 0][near], axis=1).ravel())
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(size.recall * len(needed))))]) + 1
    return index


def plane_index(x: np.ndarray, rows: int, k: int, metric: Metric, size: Planes, seed: int = 42) -> PlaneIndex:
    most = size.bits or max(1, min(16, int(np.log2(max(rows, 2)))))
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], size.tables * most))
    if size.bits:
        return PlaneIndex(planes, size.tables, size.bits, size.probes or 1)
    asked, near = _truth(x, k, metric)
    best = None
    for bits in range(1, most + 1):
        index = PlaneIndex(planes, size.tables, bits, 1)
        keys = index.cells(x) - index.base
        apart = keys[asked][:, None, :] ^ keys[near]  # the bits that differ, by table
        same = index.flips(x[asked], min(MOST_PROBES, 1 << bits))[:, None] == apart[:, :, :, None]
        first = np.where(same.any(3), same.argmax(3), MOST_PROBES).min(2)  # probes until one table has the pair
        needed = np.sort(first.ravel())[min(first.size - 1, int(np.ceil(size.recall * first.size)))] + 1
        probes = size.probes or int(needed)
        work = size.tables * probes / (1 << bits)
        if probes >= needed and needed <= MOST_PROBES and (best is None or work < best[0]):
            best = (work, bits, probes)
    return PlaneIndex(planes, size.tables, *best[1:]) if best else PlaneIndex(planes, 1, 1, 2)  # everything


# ------------------------------------------------------------------ the join


def _joined(v: DataFrame, q: DataFrame, index, fill: np.ndarray, rows: int, dim: int, k: int, metric: Metric, stored: bool = False) -> DataFrame:
    """``(query_id, rank, doc_id, score)``.  ``v`` has doc_id and v, and its cell
    if it is ``stored``; ``fill`` is each cell's share of the vectors."""
    asked = q.count()
    parallel = v.sparkSession.sparkContext.defaultParallelism
    parts = np.maximum(1, np.ceil(fill * rows / PART_ROWS)).astype(np.int64)
    groups = int(min(max(parallel, np.ceil(rows * index.tables * dim / GROUP_NUMBERS)), parts.sum()))
    first = np.concatenate([[0], np.cumsum(parts)])  # a cell's parts are slots, dealt to the groups
    visits = min(1.0, index.tables * index.probes * parts.max() / groups)
    shares = int(max(1, np.ceil(asked * visits * dim / ASKED_NUMBERS)))  # of the queries of a group
    slices = lambda b, each: (b.slice(i, step) for step in [max(1, SENT_NUMBERS // int(max(1, dim * each)))] for i in range(0, b.num_rows, step))
    ids, docs = q.schema["query_id"].dataType.simpleString(), v.schema["doc_id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, index.tables * shares)):
            cells = b.column("cell").to_numpy().astype(np.int64)[:, None] if stored else index.cells(_points(b.column("v"), metric))
            part = b.column("h").to_numpy()[:, None] % parts[cells]
            row = np.repeat(np.arange(b.num_rows), cells.shape[1] * shares)
            at = np.repeat((first[cells] + part).ravel(), shares)
            share = np.tile(np.arange(shares), cells.size)
            yield pa.RecordBatch.from_arrays([pa.array((at % groups * shares + share).astype(np.int64)), pa.array(at), b.column("doc_id").take(pa.array(row)), _lists(matrix(b.column("v"))[row])], ["g", "slot", "doc_id", "v"])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, min(groups, index.tables * index.probes * parts.max()))):
            share = b.column("h").to_numpy() % shares
            cells = index.probed(_points(b.column("q"), metric))
            many = parts[cells]  # each part of a probed cell is a slot to visit
            row = np.repeat(np.arange(b.num_rows), many.sum(1))
            flat, count = cells.ravel(), many.ravel()
            at = np.repeat(first[flat], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            group = at % groups
            order = np.lexsort((at, group, row))
            row, group, at = row[order], group[order], at[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))) if len(row) else np.zeros(0, np.int64)
            lengths = np.append(new, len(row)).astype(np.int32)
            row, group = row[new], group[new]
            yield pa.RecordBatch.from_arrays([pa.array(group * shares + share[row]), pa.ListArray.from_arrays(pa.array(lengths), pa.array(at)), b.column("query_id").take(pa.array(row)), _lists(matrix(b.column("q"))[row])], ["g", "slots", "query_id", "q"])

    def meet(asking: pa.Table, y: pa.Table) -> pa.Table:
        """Queries come in blocks, each of which keeps its k best only."""
        empty = pa.table({"query_id": asking.column("query_id").slice(0, 0), "doc_id": y.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(asking) or not len(y):
            return empty
        # positions follow doc_ids in a slot, and tell which vector it is in any
        y = y.sort_by([("slot", "ascending"), ("doc_id", "ascending")])
        qm, vm, slot = Points(matrix(asking.column("q")), metric), Points(matrix(y.column("v")), metric), y.column("slot").to_numpy()
        keys = y.column("doc_id").combine_chunks()
        code = keys.dictionary_encode()
        order = np.argsort(code.dictionary.to_numpy(zero_copy_only=False), kind="stable")
        place, known = np.empty(len(order), np.int64), code.dictionary.take(pa.array(order))
        place[order] = np.arange(len(order))
        place = place[code.indices.to_numpy()]
        lists = asking.column("slots").combine_chunks()
        slots, begin = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        names, low = np.unique(slot, return_index=True)
        high = np.append(low[1:], len(slot))
        found = []
        for i in range(0, len(asking), QUERY_BLOCK):
            j = min(len(asking), i + QUERY_BLOCK)
            owner, flat = np.repeat(np.arange(i, j), np.diff(begin[i : j + 1])), slots[begin[i] : begin[j]]
            by_slot = np.argsort(flat, kind="stable")
            owner, flat = owner[by_slot], flat[by_slot]
            best = Best(i, j - i, k, index.tables > 1)
            for s, lo, hi in zip(names, low, high):
                who = owner[np.searchsorted(flat, s) : np.searchsorted(flat, s, side="right")]
                if len(who):
                    compare(best, qm, vm, who, lo, hi, place)
            a, b, close = best.settle()
            found.append((a + i, b, close))
        who, which, close = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": asking.column("query_id").combine_chunks().take(pa.array(who)), "doc_id": known.take(pa.array(which)), "score": pa.array(-close if metric is Metric.L2 else close)})

    v = v.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    q = q.withColumn("h", F.xxhash64("query_id").bitwiseAND(F.lit((1 << 62) - 1)))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((q, "q"), (v, "v"))]
    a = q.mapInArrow(queries, f"g long, slots array<long>, query_id {ids}, q {kinds[0]}")
    b = v.mapInArrow(vectors, f"g long, slot long, doc_id {docs}, v {kinds[1]}")
    near = a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(meet, f"query_id {ids}, doc_id {docs}, score double")
    if index.tables > 1:
        near = near.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    order = F.asc("score") if metric.ascending else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.asc("doc_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _fitted(docs: DataFrame, key: str, vector: str, metric: Metric):
    """``(doc_id, v)`` of the vectors of one dimension, how many they are, the
    dimension and a sample."""
    v = docs.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc_id"), numbers(docs, vector).alias("v"))
    size = v.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("d")).first()
    if size.low != size.d:
        raise ValidationError(f"vectors of dimensions {size.low} to {size.d}")
    return v, size.n, size.d or 0, _sample(v, metric)


def _fill(index, x: np.ndarray) -> np.ndarray:
    """Each cell's share of a sample's vectors."""
    return np.bincount(index.cells(x).ravel(), minlength=index.count) / len(x)


def _search(docs, queries, k, metric, size, key, vector, build) -> DataFrame:
    checked_k(k)
    metric = Metric.of(metric)
    v, rows, dim, x = _fitted(docs, key, vector, metric)
    q = queries.where(F.size(vector) == dim).select("query_id", numbers(queries, vector).alias("q"))
    if not rows:
        return q.crossJoin(v).select("query_id", F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    index = build(x, rows, k, metric, size)
    if not size.probes and index.share() > EXACT_SHARE:  # exact search does less then
        return top_k_batch(v, q, k, metric, "doc_id", "v", vector_of_queries="q")
    return _joined(v, q, index, _fill(index, x), rows, dim, k, metric)


def ann_cells(docs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, size: Cells | str = "balanced", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector lies in its nearest cell; a query searches the nearest few.
    Queries of another dimension have no rows."""
    size = preset(size, CELLS) if isinstance(size, str) else size
    return _search(docs, queries, k, metric, size, key, vector, cell_index)


def ann_planes(docs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, size: Planes | str = "balanced", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Signs of random projections are hash keys; what shares one is compared."""
    size = preset(size, PLANES) if isinstance(size, str) else size
    return _search(docs, queries, k, metric, size, key, vector, plane_index)


# ------------------------------------------------------------------ to keep


def build_cells(docs: DataFrame, path: str, size: Cells | str = "balanced", metric: Metric | str = Metric.COSINE, key: str = "vec_id", vector: str = "embedding") -> None:
    """Write the vectors by cell, and the centres beside them; to build again is
    to write another path."""
    metric, size = Metric.of(metric), preset(size, CELLS) if isinstance(size, str) else size
    v, rows, _, x = _fitted(docs, key, vector, metric)
    index = cell_index(x, rows, 10, metric, size)
    fill = _fill(index, x)
    kind = v.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _points(b.column("v"), metric)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(m), pa.array(index.cells(m)[:, 0].astype(np.int32))], ["doc_id", "v", "cell"])

    docs.sparkSession.createDataFrame([(i, c.tolist(), float(f), index.probes) for i, (c, f) in enumerate(zip(index.centres, fill))], "cell int, centre array<double>, fill double, probes int").coalesce(1).write.parquet(f"{path}/centres")
    cells = v.mapInArrow(run, f"doc_id {kind}, v array<double>, cell int")
    # a hot cell's rows go to several tasks
    parts = F.element_at(F.lit(np.maximum(1, np.ceil(fill * rows / PART_ROWS)).astype(int).tolist()), F.col("cell") + 1)
    cells.repartition("cell", F.pmod(F.xxhash64("doc_id"), parts.cast("long"))).write.partitionBy("cell").parquet(f"{path}/cells")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, metric: Metric | str = Metric.COSINE, vector: str = "embedding") -> DataFrame:
    """Search what ``build_cells`` wrote; cells that no query probes are pruned
    before they are read."""
    checked_k(k)
    metric = Metric.of(metric)
    known = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    index = CellIndex(np.array([r.centre for r in known]), probes or known[0].probes, metric)
    dim = index.centres.shape[1]
    q = queries.where(F.size(vector) == dim).select("query_id", numbers(queries, vector).alias("q"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(index.probed(_points(b.column("q"), metric))).astype(np.int32))], ["cell"])

    cells = sorted(r.cell for r in q.mapInArrow(wanted, "cell int").distinct().collect())  # at most one a centre
    v = spark.read.parquet(f"{path}/cells")
    return _joined(v.where(F.col("cell").isin(cells)), q, index, np.array([r.fill for r in known]), v.count(), dim, k, metric, stored=True)
