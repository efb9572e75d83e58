"""Collections on a shared file system: a change log, snapshots and a manifest.

A collection's folder has numbered generations.  A generation is a snapshot
(none at first) and the log since; compaction writes the next generation whole
before its manifest, so readers see one or the other.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.errors import AlreadyExists, NotFound, ValidationError
from plumbob.functions.vectors import Metric, validated
from plumbob.operators import changelog, collections, search
from plumbob.operators.catalog import check_collection
from plumbob.sources import snapshots

CHANGES = "lsn BIGINT, type STRING, doc_id STRING, vector ARRAY<FLOAT>, external_id STRING, metadata STRING, inserted_at TIMESTAMP"
STATE = "doc_id STRING, lsn BIGINT, vector ARRAY<FLOAT>, external_id STRING, metadata STRING, inserted_at TIMESTAMP"
DOCUMENT = ("doc_id", "external_id", "vector", "metadata", "inserted_at")
SETTINGS = "name STRING, dimension INT, metric STRING, model STRING, created_at TIMESTAMP"
GENERATION = "number INT, snapshot_id STRING, base_lsn BIGINT"


class Store:
    """The collections below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, name: str, dimension: int, metric: str = "cosine", model: str = "none") -> "Collection":
        check_collection(name, dimension, model)
        Metric.of(metric)
        if snapshots.exists(self.spark, f"{self.path}/{name}"):
            raise AlreadyExists(f"collection {name} already exists")
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric"), F.lit(model).alias("model"), F.current_timestamp().alias("created_at"))
        row.coalesce(1).write.json(f"{self.path}/{name}/settings")
        return Collection(self, name)

    def collection(self, name: str) -> "Collection":
        if not snapshots.exists(self.spark, f"{self.path}/{name}/settings"):
            raise NotFound(f"collection {name} not found")
        return Collection(self, name)

    def collections(self) -> DataFrame:
        """``(name, dimension, metric, model, created_at)`` in order of creation."""
        if not snapshots.exists(self.spark, self.path):
            return self.spark.createDataFrame([], SETTINGS)
        return self.spark.read.schema(SETTINGS).json(f"{self.path}/*/settings").orderBy("created_at", "name")

    def drop(self, name: str) -> None:
        self.collection(name)
        snapshots._delete(self.spark, f"{self.path}/{name}")


class Collection:
    def __init__(self, store: Store, name: str):
        self.spark, self.name, self.path = store.spark, name, f"{store.path}/{name}"
        settings = self.spark.read.schema(SETTINGS).json(f"{self.path}/settings").first()
        self.dimension, self.metric = settings.dimension, Metric.of(settings.metric)

    # ---------------------------------------------------------------- state

    def generation(self):
        """``(number, snapshot_id, base_lsn)`` of the newest generation."""
        if not snapshots.exists(self.spark, f"{self.path}/generations"):
            return 0, None, 1
        rows = self.spark.read.schema(GENERATION).json(f"{self.path}/generations")
        return tuple(rows.orderBy(F.desc("number")).first())

    def log(self) -> DataFrame:
        folder = f"{self.path}/log/{self.generation()[0]}"
        return self.spark.read.schema(CHANGES).parquet(folder) if snapshots.exists(self.spark, folder) else self.spark.createDataFrame([], CHANGES)

    def _state(self) -> DataFrame:
        _, snapshot_id, base = self.generation()
        old = snapshots.restore(self.spark, self.path, snapshot_id, STATE) if snapshot_id else self.spark.createDataFrame([], STATE)
        return changelog.recover(old, self.log(), base)

    def documents(self) -> DataFrame:
        return self._state().select(*DOCUMENT)

    def count(self) -> int:
        return collections.count(self._state()).first().documents

    def get(self, doc_id: str):
        return collections.get(self.documents(), doc_id).first()

    # -------------------------------------------------------------- changes

    def _append(self, changes: DataFrame) -> None:
        number, _, base = self.generation()
        last = self.log().agg(F.coalesce(F.max("lsn"), F.lit(base - 1)).alias("lsn"))
        rows = changelog.append(last, changes, "doc_id")
        rows.select("lsn", "type", "doc_id", *(F.col(c) for c in ("vector", "external_id", "metadata", "inserted_at"))).write.mode("append").parquet(f"{self.path}/log/{number}")

    def _checked(self, docs: DataFrame) -> DataFrame:
        have = {c: F.col(c) if c in docs.columns else F.lit(None) for c in DOCUMENT}
        rows = docs.select(have["doc_id"].cast("string").alias("doc_id"), have["vector"].cast("array<float>").alias("vector"), have["external_id"].cast("string").alias("external_id"), have["metadata"].cast("string").alias("metadata"), F.coalesce(have["inserted_at"].cast("timestamp"), F.current_timestamp()).alias("inserted_at"))
        if row := validated(rows, "vector", self.dimension, self.metric).where("problem IS NOT NULL OR doc_id IS NULL").first():
            raise ValidationError(f"document {row.doc_id}: {row.problem or 'no id'}")
        return rows

    def insert(self, docs: DataFrame) -> None:
        """All rows or none; an id that is taken or repeated is an error."""
        rows = self._checked(docs)
        if row := collections.insert_outcome(self._state(), rows).where("NOT accepted").first():
            raise AlreadyExists(f"document {row.doc_id} already exists")
        self._append(rows.withColumn("type", F.lit("upsert")))

    def upsert(self, docs: DataFrame) -> None:
        """Rows replace those of equal ids; of repeated ids the newest stays, of
        equally new ones the largest."""
        rows = self._checked(docs)
        rest = ["inserted_at", *(c for c in DOCUMENT if c not in ("doc_id", "inserted_at"))]
        last = rows.groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("_last")).select("doc_id", "_last.*")
        self._append(last.select(*DOCUMENT).withColumn("type", F.lit("upsert")))

    def delete(self, keys: DataFrame, strict: bool = True) -> None:
        """Delete the documents of ``keys(doc_id)``; a missing one is an error if strict."""
        gone = keys.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        if strict and (row := gone.join(self._state().select("doc_id"), "doc_id", "left_anti").first()):
            raise NotFound(f"document {row.doc_id} not found")
        empty = {"vector": "array<float>", "external_id": "string", "metadata": "string", "inserted_at": "timestamp"}
        self._append(gone.withColumn("type", F.lit("delete")).withColumns({c: F.lit(None).cast(k) for c, k in empty.items()}))

    def should_compact(self) -> bool:
        size = changelog.entry_bytes(F.lit(self.dimension), F.col("external_id"), F.col("metadata"))
        return changelog.should_compact(self.log(), size).first().compact

    def compact(self) -> None:
        """Begin a generation with a snapshot of the state and an empty log."""
        number, old, base = self.generation()
        state, log = self._state(), self.log()
        after = max(base, (log.agg(F.max("lsn")).first()[0] or 0) + 1)
        snapshot_id = snapshots.create(state.select(*(c.split()[0] for c in STATE.split(", "))), self.path, self.name) if state.head(1) else None
        row = self.spark.createDataFrame([(number + 1, snapshot_id, after)], GENERATION)
        row.coalesce(1).write.mode("append").json(f"{self.path}/generations")
        snapshots._delete(self.spark, f"{self.path}/log/{number}")
        if old:
            snapshots.remove(self.spark, self.path, old)

    # --------------------------------------------------------------- search

    def search(self, query, k: int, where=None) -> DataFrame:
        """``(doc_id, score, external_id, metadata)`` of the k closest, exactly."""
        q = search.checked_query(query, self.dimension, self.metric)
        return search.top_k(self.documents(), q, k, self.metric, "doc_id", "vector", ("external_id", "metadata"), where)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, doc_id, score)`` for all of ``queries(query_id, vector)``."""
        return search.top_k_batch(self.documents(), queries, k, self.metric, "doc_id", "vector")

    def describe(self) -> DataFrame:
        return collections.describe(self.documents(), "vector")
