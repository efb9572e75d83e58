"""Structured Streaming forms: log tail, access statistics, breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbob.operators.changelog import latest_changes, materialize
from plumbob.operators.resilience import breaker_steps
from plumbob.sources.snapshots import _delete
from plumbob.sources.wal import parsed


def log_tail(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Changes as log files arrive; ``files`` of them a trigger at most."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files).text(path))


def maintain_state(changes: DataFrame, path: str, checkpoint: str, key: str = "doc_id", lsn: str = "lsn", kind: str = "type", versions: int = 3):
    """Keep the last change of each key in ``path/<version>``, named by batch.

    A batch is merged with the state before it and written anew under its own
    number, so a repeated batch gives the same version and readers of the one
    before aren't disturbed.  Deletions stay as tombstones, for late changes of
    smaller numbers.  The last ``versions`` are kept.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(kind).isin("upsert", "delete") & F.col(key).isNotNull())
        if number:
            rows = spark.read.parquet(f"{path}/{number - 1}").unionByName(rows)
        latest_changes(rows, key, lsn, kind).write.mode("overwrite").parquet(f"{path}/{number}")
        if number >= versions:
            _delete(spark, f"{path}/{number - versions}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def state_of(spark: SparkSession, path: str, version: int, key: str = "doc_id", lsn: str = "lsn", kind: str = "type") -> DataFrame:
    """The live rows of a version that ``maintain_state`` wrote."""
    return materialize(spark.read.parquet(f"{path}/{version}"), key, lsn, kind)


def windowed_access(events: DataFrame, key: str, ts: str, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``(window_start, key, accesses, last_accessed_at)``; rows later than
    ``late`` are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(w.alias("_w"), key).agg(F.count("*").alias("accesses"), F.max(ts).alias("last_accessed_at")).select(F.col("_w.start").alias("window_start"), key, "accesses", "last_accessed_at")


def breakers(events: DataFrame, key: str, ts: str, failed: str) -> DataFrame:
    """``(key, ts, state)``: each backend's breaker after each request, in the
    order of a batch's times; its state is kept between batches."""
    rows = events.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(failed).cast("boolean").alias("bad"))
    kind = rows.schema[key].dataType.simpleString()

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = None
        if state.exists:
            name, since, good, times, bads = state.get
            known = {"name": name, "since": since, "good": good, "recent": list(zip(times, bads))}
        f = pd.concat(list(frames)).sort_values("t")
        states, known = breaker_steps(f.t.tolist(), f.bad.tolist(), known)
        state.update((known["name"], known["since"], known["good"], [float(t) for t, _ in known["recent"]], [bool(b) for _, b in known["recent"]]))
        yield pd.DataFrame({key: [group[0]] * len(f), "t": f.t, "state": states})

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t double, state string", "name string, since double, good int, times array<double>, bads array<boolean>", "append", GroupStateTimeout.NoTimeout)


def uploads(docs: DataFrame, path: str, checkpoint: str, by: str = "collection_id", rows: int = 100, wait: str = "5 seconds"):
    """Batches of at most ``rows`` documents, written after ``wait`` at latest."""
    return docs.writeStream.trigger(processingTime=wait).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows).partitionBy(by).format("parquet").option("path", path)
