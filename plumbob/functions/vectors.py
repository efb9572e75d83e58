"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns.

All arithmetic is in DOUBLE.  Vectors of different lengths give null in the
expressions; ``validated`` finds them before.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.errors import ValidationError

#: Vectors of a block, and pairs of two blocks that a task makes at once.  A
#: vector is sent once for each block, so shuffle is the square of the vectors
#: by the first.
PAIR_BLOCK, PAIR_ROWS = 8000, 1 << 20


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector) -> Column:
    """A vector given on the driver, as an array of doubles."""
    return F.array(*(F.lit(float(x)) for x in vector)).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))))


def dot(a: Column | str, b: Column | str) -> Column:
    return _pairs(column(a), column(b), lambda x, y: x * y)


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance; lower is closer."""
    return F.sqrt(_pairs(column(a), column(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(column(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.when(F.size(column(a)) == F.size(column(b)), 0.0)).otherwise(dot(a, b) / scale)


def normalized(v: Column | str) -> Column:
    """The vector over its norm; a zero vector is left as it is."""
    v = column(v).cast("array<double>")
    # the norm is bound once, not computed anew for each element
    return F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))[0]


def cosine_of_distance(distance: Column | str) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    d = column(distance)
    return 1 - d * d / 2


def dimension(v: Column | str) -> Column:
    return F.size(column(v))


def bad_element(v: Column | str) -> Column:
    """Index from 0 of the first element that is null or not finite, else null."""
    wrong = F.transform(column(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    at = F.array_position(wrong, True)
    return F.when(at > 0, at - 1)


class Metric(Enum):
    COSINE = "cosine"
    DOT = "dot"
    L2 = "l2"

    @classmethod
    def of(cls, name: "Metric | str") -> "Metric":
        try:
            return name if isinstance(name, cls) else cls(name)
        except ValueError:
            raise ValidationError(f"unknown metric: {name}") from None

    def score(self, a: Column | str, b: Column | str) -> Column:
        """The plan's expression; chosen while the plan is built."""
        return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.L2: l2}[self](a, b)

    @property
    def ascending(self) -> bool:
        """Whether small scores are close."""
        return self is Metric.L2


def problem(v: Column | str, dim: int, metric: Metric | str = Metric.L2) -> Column:
    """What makes a vector unfit for a collection, or null."""
    v = column(v)
    at = bad_element(v)
    out = F.when(v.isNull(), F.lit("null vector")).when(F.size(v) != dim, F.concat(F.lit(f"dimension {dim} expected, found "), F.size(v))).when(at.isNotNull(), F.concat(F.lit("element "), at, F.lit(" isn't finite")))
    return out.when(norm(v) == 0, F.lit("zero vector")) if Metric.of(metric) is Metric.COSINE else out


def validated(df: DataFrame, vector: str, dim: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """``df`` with the column ``problem``."""
    return df.withColumn("problem", problem(vector, dim, metric))


def off_unit(v: Column | str, tolerance: float = 0.01) -> Column:
    return F.abs(norm(v) - 1) > tolerance


def mean_pooled(tokens: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """``(key, vector)``: mean of a key's vectors by element, of those that the
    mask admits.  Vectors travel as partial sums by (key, position)."""
    rows = tokens.where(F.col(mask) != 0) if mask else tokens
    parts = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias(vector))


def first_pooled(tokens: DataFrame, key: str, vector: str, position: str) -> DataFrame:
    """``(key, vector)``: each key's vector of the least position."""
    return tokens.groupBy(key).agg(F.min_by(vector, position).alias(vector))


def _matrix(vectors: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, all of one length, as a matrix of doubles."""
    taken = vectors.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1 if len(taken.flatten()) else 0)


def closeness(q: np.ndarray, v: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores of each row of ``q`` with each of ``v``."""
    if metric is Metric.L2:  # differences in place of products, which lose digits
        return np.stack([np.linalg.norm(v - x, axis=1) for x in q]) if len(q) else np.zeros((0, len(v)))
    if metric is Metric.COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            q, v = (np.nan_to_num(x / np.linalg.norm(x, axis=1)[:, None]) for x in (q, v))
    return q @ v.T


def pairwise(df: DataFrame, key: str, vector: str, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """``(a, b, score)`` of all pairs with a < b; the score is null where a
    vector is null or the lengths differ.

    Rows are cut into blocks, and each pair of blocks meets in one task as one
    matrix product, some rows of it at a time; a vector is sent once for each
    block, floats as they are.
    """
    metric = Metric.of(metric)
    kind = df.schema[vector].dataType.simpleString()
    sent = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), sent.alias("v"))
    count = max(4, -(-rows.count() // PAIR_BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        keys, vectors, own = (group.column(c).combine_chunks() for c in ("k", "v", "own"))
        side, i, j = own.to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
        ids = keys.to_numpy(zero_copy_only=False)
        right = np.flatnonzero(side == j)
        all_left = np.flatnonzero(side == i)
        step = max(1, PAIR_ROWS // max(1, len(right)))
        for left in (all_left[r : r + step] for r in range(0, len(all_left), step)):
            score = np.full((len(left), len(right)), np.nan)
            fits = np.zeros(score.shape, bool)
            for n in np.intersect1d(size[left], size[right]):
                x, y = np.flatnonzero(size[left] == n), np.flatnonzero(size[right] == n)
                if n >= 0:
                    score[np.ix_(x, y)] = closeness(_matrix(vectors, left[x]), _matrix(vectors, right[y]), metric)
                    fits[np.ix_(x, y)] = True
            low = ids[left][:, None] < ids[right][None, :]
            if i == j:
                x, y = np.nonzero(low)
                a, b = left[x], right[y]
            else:
                x, y = np.nonzero(low | (ids[left][:, None] > ids[right][None, :]))
                a, b = np.where(low[x, y], left[x], right[y]), np.where(low[x, y], right[y], left[x])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(score[x, y], mask=~fits[x, y])], ["a", "b", "score"])

    return rows.withColumn("m", meets).select("k", "v", "own", "m.i", "m.j").groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, score double")
