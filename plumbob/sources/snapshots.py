"""Snapshots: a Parquet or JSON dataset and one manifest row beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.errors import NotFound, SerializationError, StorageError, ValidationError

FORMATS = {"parquet": ("none", "snappy", "zstd", "gzip"), "json": ("none", "gzip")}


def _manifests(path: str) -> str:
    return f"{path}/manifests"


def _removed(path: str) -> str:
    return f"{path}/removed"


def _data(path: str, snapshot_id: str) -> str:
    return f"{path}/data/{snapshot_id}"


def create(docs: DataFrame, path: str, collection_id: str, vector: str = "vector", format: str = "parquet", compression: str | None = None) -> str:
    """Write a snapshot and return its id; empty or of mixed dimensions is an error.

    The data is written before its manifest, so a snapshot that can be listed
    is whole.
    """
    compression = compression or ("snappy" if format == "parquet" else "none")
    if compression not in FORMATS.get(format, ()):
        raise SerializationError(f"no such form: {format} with {compression}")
    spark, snapshot_id = docs.sparkSession, uuid.uuid4().hex
    target = _data(path, snapshot_id)
    writer = docs.write.option("compression", compression if compression != "none" or format == "json" else "uncompressed")
    if format == "parquet":
        writer.option("parquet.enable.dictionary", "true").option("parquet.block.size", str(128 << 20)).parquet(target)
    else:
        writer.option("ignoreNullFields", "false").json(target)
    written = spark.read.schema(docs.schema).format(format).load(target)
    found = written.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if not found.n or found.low != found.high or found.low < 0:
        _delete(spark, target)
        raise ValidationError("a snapshot needs documents of one dimension")
    manifest = spark.range(1).select(
        F.lit(snapshot_id).alias("snapshot_id"), F.lit(collection_id).alias("collection_id"), F.lit(found.n).cast("long").alias("vector_count"), F.lit(found.high).alias("dimension"),
        F.current_timestamp().alias("created_at"), F.lit(_size(spark, target)).cast("long").alias("size_bytes"), F.lit(compression).alias("compression"), F.lit(format).alias("format"),
    )
    manifest.coalesce(1).write.mode("append").json(_manifests(path))
    return snapshot_id


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _size(spark: SparkSession, path: str) -> int:
    fs, target = _fs(spark, path)
    return fs.getContentSummary(target).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Those that weren't removed."""
    from plumbob.schemas import SNAPSHOT

    if not exists(spark, _manifests(path)):
        return spark.createDataFrame([], SNAPSHOT)
    rows = spark.read.schema(SNAPSHOT).json(_manifests(path)).withColumn("format", F.coalesce("format", F.lit("json")))
    return rows.join(_gone(spark, path), "snapshot_id", "left_anti")


def _gone(spark: SparkSession, path: str) -> DataFrame:
    """``(snapshot_id)`` of removed snapshots."""
    if not exists(spark, _removed(path)):
        return spark.createDataFrame([], "snapshot_id string")
    return spark.read.schema("snapshot_id string").json(_removed(path)).distinct()


def listed(snapshots: DataFrame, collection_id: str | None = None) -> DataFrame:
    """Newest first."""
    rows = snapshots if collection_id is None else snapshots.where(F.col("collection_id") == collection_id)
    return rows.orderBy(F.desc("created_at"), "snapshot_id")


def manifest(spark: SparkSession, path: str, snapshot_id: str):
    row = manifests(spark, path).where(F.col("snapshot_id") == snapshot_id).first()
    if row is None:
        raise NotFound(f"snapshot {snapshot_id} not found")
    return row


def restore(spark: SparkSession, path: str, snapshot_id: str, schema) -> DataFrame:
    """A snapshot's documents; a count that isn't the manifest's is an error."""
    row = manifest(spark, path, snapshot_id)
    if not exists(spark, _data(path, snapshot_id)):
        raise StorageError(f"snapshot {snapshot_id} has no data")
    docs = spark.read.schema(schema).format(row.format).load(_data(path, snapshot_id))
    if docs.count() != row.vector_count:
        raise StorageError(f"snapshot {snapshot_id}: {row.vector_count} documents expected")
    return docs


def verified(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """Whether both data and manifest are there."""
    return manifests(spark, path).where(F.col("snapshot_id") == snapshot_id).first() is not None and exists(spark, _data(path, snapshot_id))


def remove(spark: SparkSession, path: str, snapshot_id: str) -> None:
    """Take a snapshot off the list, then delete its data.

    Manifests are never rewritten: a row that names the removed one is added.
    If the removal is interrupted after it, ``sweep`` deletes the data.
    """
    manifest(spark, path, snapshot_id)
    row = spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"))
    row.coalesce(1).write.mode("append").json(_removed(path))
    _delete(spark, _data(path, snapshot_id))


def sweep(spark: SparkSession, path: str) -> int:
    """Delete what interrupted removals left; how many there were.  Ids are
    read one at a time, as there may be many removed ones."""
    count = 0
    for row in _gone(spark, path).toLocalIterator():
        if exists(spark, _data(path, row.snapshot_id)):
            _delete(spark, _data(path, row.snapshot_id))
            count += 1
    return count


# -------------------------------------------------------------- object stores


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, modified_at, bytes)`` of all files below a folder, without
    their contents read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def head(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of change (milliseconds) of a file."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        raise NotFound(f"{path} not found")
    status = fs.getFileStatus(target)
    return status.getLen(), status.getModificationTime()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder, from one store to another as well."""
    (a, x), (b, y) = _fs(spark, source), _fs(spark, target)
    if not a.exists(x):
        raise NotFound(f"{source} not found")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark._jsc.hadoopConfiguration()):
        raise StorageError(f"{source} wasn't copied")


def interchange(docs: DataFrame, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """The columns of the exchange format; ids of 16 bytes, dimension beside."""
    have = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    return docs.select(
        F.unhex(F.translate(F.col(key), "-", "")).alias("document_id"), have("external_id", "string").alias("external_id"), F.size(vector).cast("long").alias("dimension"),
        F.col(vector).cast("array<float>").alias("vector"), have("metadata", "string").alias("metadata_json"), F.date_trunc("millisecond", have("inserted_at", "timestamp")).cast("timestamp_ntz").alias("inserted_at"),
    )


def from_interchange(rows: DataFrame) -> DataFrame:
    """Back to documents; an id that isn't 16 bytes long is an error on its row."""
    h = F.lower(F.hex("document_id"))
    text = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return rows.select(F.when(F.length(h) == 32, text).otherwise(F.raise_error(F.lit("document_id isn't 16 bytes long"))).alias("doc_id"), "external_id", "vector", F.col("metadata_json").alias("metadata"), F.col("inserted_at").cast("timestamp").alias("inserted_at"))


def write_batches(docs: DataFrame, path: str, by: str, rows: int = 100, tasks: int | None = None) -> None:
    """Files of at most ``rows`` documents in a folder for each value of ``by``;
    ``tasks`` writers at once."""
    if not 1 <= rows <= 10_000:
        raise ValidationError("a batch has 1 to 10000 documents")
    if tasks is not None and not 1 <= tasks <= 50:
        raise ValidationError("1 to 50 writers")
    out = docs.repartition(tasks, by) if tasks else docs.repartition(by)
    out.write.option("maxRecordsPerFile", rows).partitionBy(by).parquet(path)


def batch_files(docs: DataFrame, by: str, rows: int = 100) -> DataFrame:
    """``(by, documents, files)`` that ``write_batches`` gives at least."""
    return docs.groupBy(by).agg(F.count("*").alias("documents"), F.ceil(F.count("*") / rows).cast("long").alias("files"))
