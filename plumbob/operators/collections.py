"""Keyed collections: insert, delete, get, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbob.errors import AlreadyExists, NotFound, ValidationError
from plumbob.functions.vectors import Metric, problem


def insert_outcome(current: DataFrame, incoming: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """``incoming`` with ``accepted``: whether its key is new; of equal new keys
    the first in ``order`` is, or in the order of all columns without it.  Only
    keys of ``current`` are shuffled."""
    rest = [order] if order else [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in incoming.dtypes if c != key]
    taken = current.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_taken", F.lit(True))
    rows = incoming.join(taken, key, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*rest or [F.lit(1)]))
    return rows.withColumn("accepted", F.col(key).isNotNull() & F.col("_taken").isNull() & (first == 1)).drop("_taken")


def insert_unique(current: DataFrame, incoming: DataFrame, key: str = "doc_id", vector: str | None = None, dim: int | None = None, metric: Metric | str = Metric.L2, strict: bool = False) -> DataFrame:
    """``current`` and the accepted rows of ``incoming``; all or nothing if strict."""
    judged = insert_outcome(current, incoming, key)
    if vector is not None:
        bad = problem(vector, dim, metric)
        if strict and (row := incoming.select(bad.alias("p")).where("p IS NOT NULL").first()):
            raise ValidationError(row.p)
        judged = judged.withColumn("accepted", F.col("accepted") & bad.isNull())
    if strict and (row := judged.where(~F.col("accepted")).first()):
        raise AlreadyExists(f"document {row[key]} already exists")
    return current.unionByName(judged.where("accepted").drop("accepted"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``incoming`` replace those of equal keys."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete(current: DataFrame, keys: DataFrame, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """``current`` without the rows whose keys ``keys`` has."""
    gone = keys.select(key).distinct()
    if strict and (row := gone.join(current.select(key), key, "left_anti").first()):
        raise NotFound(f"document {row[key]} not found")
    return current.join(gone, key, "left_anti")


def soft_delete(current: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``current`` with ``deleted`` set where ``keys`` has the key."""
    gone = keys.select(key).distinct().withColumn("deleted", F.lit(True))
    return current.join(gone, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def get(current: DataFrame, key_value, key: str = "doc_id") -> DataFrame:
    """The rows of a key; the filter reaches the scan."""
    return current.where(F.col(key) == key_value)


def count(current: DataFrame) -> DataFrame:
    """``(documents)``; rows marked ``deleted`` don't count."""
    live = F.sum(F.when(F.col("deleted"), 0).otherwise(1)) if "deleted" in current.columns else F.count("*")
    return current.agg(F.coalesce(live, F.lit(0)).cast("long").alias("documents"))


def cleared(current: DataFrame) -> DataFrame:
    return current.limit(0)


def describe(current: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(documents, dimension, dimensions, off_unit)`` as they are."""
    from plumbob.functions.vectors import off_unit

    return current.agg(F.count("*").alias("documents"), F.max(F.size(vector)).alias("dimension"), F.countDistinct(F.size(vector)).alias("dimensions"), F.sum(off_unit(vector).cast("int")).alias("off_unit"))
