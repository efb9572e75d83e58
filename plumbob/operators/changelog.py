"""The change log: append, replay, materialise, compact, recover.

A change is ``(lsn, type, doc_id, ...)``; ``type`` is upsert, delete,
create_collection, delete_collection or checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbob.workdir import ensure_checkpoint_dir

LOG_BYTES, LOG_INSERTS, KEPT_FILES = 100 << 20, 10_000, 10


def append(log: DataFrame, incoming: DataFrame, order: str, lsn: str = "lsn") -> DataFrame:
    """``incoming`` with dense log numbers after the log's last, in ``order``.

    Numbers are offsets of range partitions plus a row's place in its own.  The
    places are checkpointed: ranges are sampled, and a task that ran again
    might cut them differently.
    """
    ensure_checkpoint_dir(log.sparkSession)
    last = log.agg(F.coalesce(F.max(lsn), F.lit(0)).alias("_last"))
    rows = incoming.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id").checkpoint()
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(before), "_part").crossJoin(F.broadcast(last))
    return out.withColumn(lsn, (F.col("_last") + F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before", "_last")


def replay(log: DataFrame, start: int = 0, lsn: str = "lsn") -> DataFrame:
    """Changes from ``start`` on, in order; rows are filtered, not files."""
    return log.where(F.col(lsn) >= start).orderBy(lsn)


def materialize(log: DataFrame, key: str = "doc_id", lsn: str = "lsn", kind: str = "type") -> DataFrame:
    """The last change of each key, where that is an upsert; of changes with one
    number an upsert, then the one of the largest values.  One shuffle, with
    partial maxima before it; other kinds of change don't matter."""
    last = latest_changes(log, key, lsn, kind)
    return last.where(F.col(kind) == "upsert").drop(kind)


def latest_changes(log: DataFrame, key: str = "doc_id", lsn: str = "lsn", kind: str = "type") -> DataFrame:
    """The last upsert or delete of each key, in the log's columns."""
    rows = log.where(F.col(kind).isin("upsert", "delete") & F.col(key).isNotNull())
    rest = [lsn, kind, *(c for c, t in rows.dtypes if c not in (key, lsn, kind) and "map<" not in t and t != "variant")]
    loose = [c for c in rows.columns if c != key and c not in rest]  # maps have no order
    whole = F.max_by(F.struct(*rest, *loose), F.struct(*rest)) if loose else F.max(F.struct(*rest))
    return rows.groupBy(key).agg(whole.alias("_last")).select(key, *(F.col(f"_last.{c}") for c in log.columns if c != key))


def compacted(log: DataFrame, key: str = "doc_id", lsn: str = "lsn", kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """The snapshot of a log and its first number after, ``(base_lsn)``."""
    return materialize(log, key, lsn, kind), log.agg((F.coalesce(F.max(lsn), F.lit(0)) + 1).alias("base_lsn"))


def recover(snapshot: DataFrame, log: DataFrame, base: int, key: str = "doc_id", lsn: str = "lsn", kind: str = "type") -> DataFrame:
    """State from a snapshot and the log from ``base`` on.

    Keys that the tail names are taken from it alone, so deletions after the
    snapshot hold.
    """
    tail = log.where(F.col(lsn) >= base)
    touched = tail.where(F.col(kind).isin("upsert", "delete")).select(key).distinct()
    return snapshot.join(touched, key, "left_anti").unionByName(materialize(tail, key, lsn, kind))


def entry_bytes(dim: Column, external_id: Column, metadata: Column) -> Column:
    """What a log entry is taken to weigh."""
    return F.lit(16) + 4 * dim + 100 + F.coalesce(F.octet_length(external_id), F.lit(0)) + F.when(metadata.isNull(), 0).otherwise(200)


def should_compact(log: DataFrame, size: Column, most_bytes: int = LOG_BYTES, most_inserts: int = LOG_INSERTS, kind: str = "type") -> DataFrame:
    """``(wal_bytes, inserts, compact)``."""
    sums = log.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("wal_bytes"), F.coalesce(F.sum(F.when(F.col(kind) == "upsert", 1).otherwise(0)), F.lit(0)).cast("long").alias("inserts"))
    return sums.withColumn("compact", (F.col("wal_bytes") >= most_bytes) | (F.col("inserts") >= most_inserts))


def retained(files: DataFrame, order: str, kept: int = KEPT_FILES, group: str | None = None) -> DataFrame:
    """``files`` with ``kept``: whether a log file is among the newest."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(order))
    return files.withColumn("kept", F.row_number().over(w) <= kept)
