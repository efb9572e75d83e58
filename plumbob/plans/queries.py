"""Queries over the driver's tables and the DuckDB SQL for the same rows.

``events`` stands in for change, access and request logs (lsn = event_id, key =
user_id, deletion or failure = the type error, latency = value), ``embeddings``
for a collection, TPC-H-like tables for the catalog.  Scores are given as whole
millionths, so that rows compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.functions import embedding, vectors
from plumbob.functions.vectors import Metric
from plumbob.operators import ann, catalog, changelog, collections, graph, metrics, resilience, search, tiering
from plumbob.sources import imports, snapshots, wal
from plumbob.store import Store
from plumbob.workdir import work_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NOW = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
K = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micro(c: Column | str) -> Column:
    return F.floor(vectors.column(c) * 1e6 + 0.5).cast("long")


def _micro(sql: str) -> str:
    return f"CAST(floor(({sql}) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _vector_of(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """The query vector of the single-query searches."""
    row = read(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


# ------------------------------------------------------------------- vectors

NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
DOT, DIST, COS = ("{}(a.embedding::DOUBLE[], b.embedding::DOUBLE[])".format(f) for f in ("list_inner_product", "list_distance", "list_cosine_similarity"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"SELECT a.vec_id, {_micro(DOT)} AS score {NEXT}")
def dot_product(spark, sf):
    return neighbours(spark, sf).select("vec_id", micro(vectors.dot("a", "b")).alias("score"))


@query(f"SELECT a.vec_id, {_micro(DIST)} AS score {NEXT}")
def l2_distance(spark, sf):
    return neighbours(spark, sf).select("vec_id", micro(vectors.l2("a", "b")).alias("score"))


@query(f"SELECT a.vec_id, {_micro(COS)} AS score {NEXT}")
def cosine_similarity(spark, sf):
    return neighbours(spark, sf).select("vec_id", micro(vectors.cosine("a", "b")).alias("score"))


@query(" UNION ALL ".join(f"SELECT a.vec_id, '{m}' AS metric, {_micro(x)} AS score {NEXT}" for m, x in (("dot", DOT), ("l2", DIST), ("cosine", COS))))
def metric_dispatch(spark, sf):
    rows = neighbours(spark, sf)
    scores = F.array(*(F.struct(F.lit(m.value).alias("metric"), micro(m.score("a", "b")).alias("score")) for m in Metric))
    return rows.select("vec_id", F.explode(scores).alias("s")).select("vec_id", "s.metric", "s.score")


@query(f"SELECT vec_id, list_transform(v, lambda x: {_micro('x / sqrt(list_inner_product(v, v))')}) AS unit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 2)) AS v FROM embeddings)")
def l2_normalize(spark, sf):
    scaled = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("v"))
    return scaled.select("vec_id", F.transform(vectors.normalized("v"), micro).alias("unit"))


@query(f"SELECT a.vec_id, {_micro(f'1 - {DIST} * {DIST} / 2')} AS score {NEXT}")
def cosine_from_l2(spark, sf):
    return neighbours(spark, sf).select("vec_id", micro(vectors.cosine_of_distance(vectors.l2("a", "b"))).alias("score"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def vector_dim(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", vectors.dimension("embedding").alias("dim"))


@query("""WITH v AS (SELECT vec_id, CASE label WHEN 0 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN 1 THEN list_slice(embedding, 1, 32) WHEN 2 THEN list_concat(list_slice(embedding, 1, 63), ['inf'::FLOAT]) WHEN 3 THEN list_concat(['nan'::FLOAT], list_slice(embedding, 2, 64)) ELSE embedding END AS v FROM embeddings),
p AS (SELECT vec_id, v, list_position(list_transform(v, lambda x: NOT isfinite(x)), true) AS bad FROM v)
SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'dimension 64 expected, found ' || len(v) WHEN bad > 0 THEN 'element ' || (bad - 1) || ' isn''t finite' WHEN list_inner_product(v::DOUBLE[], v::DOUBLE[]) = 0 THEN 'zero vector' END AS problem FROM p""")
def validate_vectors(spark, sf):
    v, label = F.col("embedding"), F.col("label")
    odd = F.when(label == 0, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(label == 1, F.slice(v, 1, 32)).when(label == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("inf")).cast("float")))).when(label == 3, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, 63))).otherwise(v)
    return vectors.validated(read(spark, sf, "embeddings").select("vec_id", odd.alias("v")), "v", 64, "cosine").select("vec_id", "problem")


@query("SELECT vec_id, abs(sqrt(list_inner_product(v, v)) - 1) > 0.01 AS off_unit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label * 0.004::DOUBLE)) AS v FROM embeddings)")
def unit_norm_audit(spark, sf):
    scaled = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label") * 0.004)).alias("v"))
    return scaled.select("vec_id", vectors.off_unit("v").alias("off_unit"))


@query(f"SELECT label, list({_micro('m')} ORDER BY i) AS pooled FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label")
def mean_pool(spark, sf):
    return vectors.mean_pooled(read(spark, sf, "embeddings"), "label", "embedding").select("label", F.transform("embedding", micro).alias("pooled"))


@query("SELECT label, arg_min(embedding, vec_id) AS pooled FROM embeddings GROUP BY label")
def cls_pool(spark, sf):
    return vectors.first_pooled(read(spark, sf, "embeddings"), "label", "embedding", "vec_id").withColumnRenamed("embedding", "pooled")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_micro(COS)} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def pairwise_similarity(spark, sf):
    return vectors.pairwise(read(spark, sf, "embeddings"), "vec_id", "embedding").select("a", "b", micro("score").alias("score"))


# -------------------------------------------------------------------- search


def _knn_sql(function: str, order: str, columns: str = "") -> str:
    score = f"{function}(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
    return f"SELECT e.vec_id, {_micro(score)} AS score{columns} FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {score} {order}, e.vec_id LIMIT {K}"


@query(_knn_sql("list_cosine_similarity", "DESC"))
def knn_cosine(spark, sf):
    return search.top_k(read(spark, sf, "embeddings"), _vector_of(spark, sf), K, "cosine").select("vec_id", micro("score").alias("score"))


@query(_knn_sql("list_distance", "ASC"))
def knn_l2(spark, sf):
    return search.top_k(read(spark, sf, "embeddings"), _vector_of(spark, sf), K, "l2").select("vec_id", micro("score").alias("score"))


@query(_knn_sql("list_inner_product", "DESC"))
def knn_dot(spark, sf):
    return search.top_k(read(spark, sf, "embeddings"), _vector_of(spark, sf), K, "dot").select("vec_id", micro("score").alias("score"))


@query(_knn_sql("list_cosine_similarity", "DESC", ", e.label, CAST(NULL AS VARCHAR) AS external_id"))
def knn_with_payload(spark, sf):
    docs = read(spark, sf, "embeddings").withColumn("external_id", F.lit(None).cast("string"))
    return search.top_k(docs, _vector_of(spark, sf), K, "cosine", keep=("label", "external_id")).select("vec_id", micro("score").alias("score"), "label", "external_id")


@query(_knn_sql("list_cosine_similarity", "DESC", ", e.label").replace("ORDER BY", "WHERE e.label <> 0 ORDER BY"))
def knn_filtered(spark, sf):
    """Beyond the reference: a filter before the search."""
    return search.top_k(read(spark, sf, "embeddings"), _vector_of(spark, sf), K, "cosine", keep=("label",), where=F.col("label") != 0).select("vec_id", micro("score").alias("score"), "label")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS external_id, score AS distance FROM ({_knn_sql('list_cosine_similarity', 'DESC')})")
def query_response(spark, sf):
    found = search.responses(search.top_k(read(spark, sf, "embeddings"), _vector_of(spark, sf), K, "cosine"))
    return found.withColumn("distance", micro("distance"))


@query("SELECT vec_id, score, 'exact' AS index FROM ({}) WHERE (SELECT count(*) FROM embeddings) <= 10000".format(_knn_sql("list_distance", "ASC")))
def service_query(spark, sf):
    """A search by the index that the collection's size asks for."""
    docs, q = read(spark, sf, "embeddings"), _vector_of(spark, sf)
    index = search.index_choice(docs.agg(F.count("*").alias("rows"))).first()["index"]
    search.checked_query(q, len(q))
    if index == "exact":
        found = search.top_k(docs, q, K, "l2")
    else:
        found = ann.ann_cells(docs, docs.where(F.col("vec_id") == 0).select(F.col("vec_id").alias("query_id"), "embedding"), K, "l2").select(F.col("doc_id").alias("vec_id"), "score")
    return found.select("vec_id", micro("score").alias("score"), F.lit(index).alias("index"))


def _ranked_sql(score: str) -> str:
    return f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {score} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b"


def _all_queries(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {_micro('s')} AS score FROM ({_ranked_sql(COS)}) WHERE rank <= {K}")
def knn_batch(spark, sf):
    """Every vector as a query."""
    return search.top_k_batch(read(spark, sf, "embeddings"), _all_queries(spark, sf), K).withColumn("score", micro("score"))


DIST_RANKED = f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {DIST} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM embeddings a, embeddings b"


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {_micro('s')} AS score FROM ({DIST_RANKED}) WHERE rank <= {K}")
def knn_batch_l2(spark, sf):
    return search.top_k_batch(read(spark, sf, "embeddings"), _all_queries(spark, sf), K, "l2").withColumn("score", micro("score"))


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {_micro('s')} AS score FROM ({_ranked_sql(DOT)}) WHERE rank <= {K}")
def knn_batch_dot(spark, sf):
    return search.top_k_batch(read(spark, sf, "embeddings"), _all_queries(spark, sf), K, "dot").withColumn("score", micro("score"))


HALF = "list_cosine_similarity(list_slice(a.embedding, 1, 32)::DOUBLE[], list_slice(b.embedding, 1, 32)::DOUBLE[])"


@query(f"""WITH x AS (SELECT query_id, doc_id FROM ({_ranked_sql(COS)}) WHERE rank <= {K}), y AS (SELECT query_id, doc_id FROM ({_ranked_sql(HALF)}) WHERE rank <= {K})
SELECT x.query_id, count(y.doc_id) / {K}::DOUBLE AS recall FROM x LEFT JOIN y ON x.query_id = y.query_id AND x.doc_id = y.doc_id GROUP BY 1""")
def recall_at_k(spark, sf):
    """Recall of a search by the first half of the dimensions."""
    docs = read(spark, sf, "embeddings")
    half = docs.withColumn("embedding", F.slice("embedding", 1, 32))
    exact = search.top_k_batch(docs, _all_queries(spark, sf), K)
    found = search.top_k_batch(half, half.select(F.col("vec_id").alias("query_id"), "embedding"), K)
    return search.recall(exact, found, K)


@query()
def ann_ivf(spark, sf):
    return ann.ann_cells(read(spark, sf, "embeddings"), _all_queries(spark, sf), K).withColumn("score", micro("score"))


@query()
def ann_lsh(spark, sf):
    return ann.ann_planes(read(spark, sf, "embeddings"), _all_queries(spark, sf), K).withColumn("score", micro("score"))


RECALL_SQL = "SELECT count(*) AS queries, true AS reached FROM embeddings"


def _recall_reached(spark, sf, found: DataFrame) -> DataFrame:
    """Whether at least 0.9 of the exact neighbours of all vectors were found."""
    exact = search.top_k_batch(read(spark, sf, "embeddings"), _all_queries(spark, sf), K)
    return search.recall(exact, found, K).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query(RECALL_SQL)
def ann_ivf_recall(spark, sf):
    return _recall_reached(spark, sf, ann.ann_cells(read(spark, sf, "embeddings"), _all_queries(spark, sf), K))


@query(RECALL_SQL)
def ann_lsh_recall(spark, sf):
    return _recall_reached(spark, sf, ann.ann_planes(read(spark, sf, "embeddings"), _all_queries(spark, sf), K))


@query(RECALL_SQL)
def ann_stored_recall(spark, sf):
    """Cells that were built and stored before they are searched."""
    path = work_path(spark, "cells")
    ann.build_cells(read(spark, sf, "embeddings"), path)
    return _recall_reached(spark, sf, ann.search_cells(spark, path, _all_queries(spark, sf), K))


@query(RECALL_SQL)
def ann_graph_recall(spark, sf):
    """Neighbour graphs that were built and stored before they are searched."""
    path = work_path(spark, "graph")
    graph.build(read(spark, sf, "embeddings"), path, "edge_cache")
    return _recall_reached(spark, sf, graph.search(spark, path, _all_queries(spark, sf), K, 64))


@query("SELECT vec_id % 4 AS collection_id, count(*) AS access_count FROM embeddings GROUP BY 1")
def search_accesses(spark, sf):
    """Searches leave accesses that the tiers' statistics count."""
    docs = read(spark, sf, "embeddings")
    logs = [search.accesses(search.top_k_batch(docs, _all_queries(spark, sf).where(F.col("query_id") % 4 == i), 1), str(i)) for i in range(4)]
    rows = logs[0].union(logs[1]).union(logs[2]).union(logs[3])
    return tiering.access_stats(rows, "collection_id", "accessed_at").select(F.col("collection_id").cast("long"), "access_count")


@query("SELECT l_returnflag AS collection, count(*) AS rows, CASE WHEN count(*) <= 10000 THEN 'exact' ELSE 'ann' END AS index FROM lineitem GROUP BY 1")
def index_choice(spark, sf):
    return search.index_choice(read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("collection")).agg(F.count("*").alias("rows")))


# --------------------------------------------------------- sources and sinks


@query("SELECT lower(regexp_replace(lpad(to_hex(vec_id), 32, '0'), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')) AS doc_id, embedding AS vector, CAST(label AS VARCHAR) AS metadata FROM embeddings")
def snapshot_roundtrip(spark, sf):
    hexed = F.lower(F.lpad(F.hex("vec_id"), 32, "0"))
    docs = read(spark, sf, "embeddings").select(F.regexp_replace(hexed, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("metadata"))
    path = work_path(spark, "exchange")
    rows = snapshots.interchange(docs)
    snapshot = snapshots.create(rows, path, "c")
    return snapshots.from_interchange(snapshots.restore(spark, path, snapshot, rows.schema)).select("doc_id", "vector", "metadata")


def _restored(spark, sf, format: str) -> DataFrame:
    docs, path = read(spark, sf, "embeddings"), work_path(spark, "snapshots")
    return snapshots.restore(spark, path, snapshots.create(docs, path, "embeddings", "embedding", format), docs.schema)


@query("SELECT vec_id, embedding, label FROM embeddings")
def json_snapshot(spark, sf):
    return _restored(spark, sf, "json")


@query("SELECT vec_id, embedding, label FROM embeddings")
def snapshot_restore(spark, sf):
    return _restored(spark, sf, "parquet")


@query("SELECT o_custkey AS collection_id, o_orderkey AS snapshot_id, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders")
def list_snapshots(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("created_at"), "snapshot_id"))
    return snapshots.listed(rows).withColumn("position", place.cast("long"))


@query("SELECT l_suppkey, count(*) AS documents, CAST(ceil(count(*) / 100.0) AS BIGINT) AS files FROM lineitem GROUP BY 1")
def batch_files(spark, sf):
    return snapshots.batch_files(read(spark, sf, "lineitem"), "l_suppkey")


@query("SELECT l_suppkey, count(*) AS documents, CAST(ceil(count(*) / 100.0) AS BIGINT) AS files FROM lineitem GROUP BY 1")
def upload_batches(spark, sf):
    """What was written, file by file."""
    path = work_path(spark, "batches")
    snapshots.write_batches(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), path, "l_suppkey")
    return spark.read.parquet(path).select(F.col("l_suppkey").cast("long").alias("l_suppkey"), F.input_file_name().alias("file")).groupBy("l_suppkey").agg(F.count("*").alias("documents"), F.countDistinct("file").alias("files"))


@query("SELECT format, compression, count(*) AS vector_count, CAST(max(len(embedding)) AS INTEGER) AS dimension, true AS verified FROM embeddings, (VALUES ('parquet', 'zstd'), ('json', 'gzip'), ('parquet', 'snappy')) f(format, compression) GROUP BY 1, 2")
def snapshot_admin(spark, sf):
    """Four snapshots of which one is removed: what is listed, and whole."""
    docs, path = read(spark, sf, "embeddings"), work_path(spark, "snapshots")
    ids = [snapshots.create(docs, path, "c", "embedding", f, c) for f, c in (("parquet", "zstd"), ("json", "gzip"), ("parquet", None), ("parquet", "gzip"))]
    snapshots.remove(spark, path, ids[-1])
    whole = [i for i in ids if snapshots.verified(spark, path, i)]
    return snapshots.manifests(spark, path).select("format", "compression", "vector_count", "dimension", F.col("snapshot_id").isin(*whole).alias("verified"))


@query("SELECT count(*) AS files, sum(documents)::BIGINT AS documents FROM (SELECT label, count(*) AS documents FROM embeddings GROUP BY 1)")
def object_files(spark, sf):
    """A copied folder's files, listed without being read, and their rows."""
    path = work_path(spark, "objects")
    read(spark, sf, "embeddings").repartition("label").write.partitionBy("label").parquet(f"{path}/a")
    snapshots.copy(spark, f"{path}/a", f"{path}/b")
    listed = snapshots.files(spark, f"{path}/b").where(F.col("path").endswith(".parquet") & (F.col("bytes") > 0)).agg(F.count("*").alias("files"))
    return listed.crossJoin(F.broadcast(spark.read.parquet(f"{path}/b").agg(F.count("*").alias("documents"))))


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def load_all_vectors(spark, sf):
    """The last stored version of each key, in order of insertion."""
    last = catalog.latest(read(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", "event_id")
    return catalog.listed(last, "ts", "user_id")


@query("SELECT label AS collection_id, count(*) AS documents FROM embeddings GROUP BY 1")
def count_vectors(spark, sf):
    return read(spark, sf, "embeddings").groupBy(F.col("label").alias("collection_id")).agg(F.count("*").alias("documents"))


@query("SELECT p_partkey AS collection_id, p_name AS name, p_size AS dimension FROM part")
def list_collections(spark, sf):
    return catalog.listed(read(spark, sf, "part").select(F.col("p_partkey").alias("collection_id"), F.col("p_name").alias("name"), F.col("p_size").alias("dimension")), "collection_id")


@query("SELECT c_custkey AS tenant_id, c_name AS name, c_mktsegment AS status FROM customer")
def list_tenants(spark, sf):
    return catalog.listed(read(spark, sf, "customer").select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status")), "tenant_id")


@query("SELECT r_name AS tenant, n_nationkey AS database_id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def list_databases(spark, sf):
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.listed(rows.select(F.col("r_name").alias("tenant"), F.col("n_nationkey").alias("database_id"), F.col("n_name").alias("name")), "tenant", "database_id")


@query("""SELECT c_custkey AS tenant_id, CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status, c_name AS name FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT -1 - s_suppkey, 'active', s_name FROM supplier""")
def tenant_changes(spark, sf):
    """Tenants created, updated and deleted."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("tenant_id"), F.lit("active").alias("status"), F.col("c_name").alias("name"), "c_acctbal", "c_nationkey")
    base = rows.select("tenant_id", "status", "name")
    more = read(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("tenant_id"), F.lit("active").alias("status"), F.col("s_name").alias("name"))
    out = catalog.created(base, more, "tenant_id", ("name",))
    out = catalog.updated(out, rows.where("c_acctbal < 0").select("tenant_id", F.lit("suspended").alias("status")), "tenant_id")
    return catalog.removed(out, rows.where("c_nationkey = 3").select("tenant_id"), "tenant_id")


@query("SELECT c_custkey AS key_id, CAST(max(o_orderdate) AS DATE) AS last_used_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def api_key_touch(spark, sf):
    keys = read(spark, sf, "customer").select(F.col("c_custkey").alias("key_id"), F.lit(None).cast("date").alias("last_used_at"))
    used = read(spark, sf, "orders").select(F.col("o_custkey").alias("key_id"), F.col("o_orderdate").cast("date").alias("used_at"))
    return catalog.touched(keys, used)


@query("SELECT c_nationkey AS tenant_id, lower(c_name) AS email, c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def user_by_email(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.lower("c_name").alias("email"), F.col("c_custkey").alias("user_id"))
    asked = users.join(read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct(), "user_id").select("tenant_id", "email")
    return catalog.users_by_email(users, asked)


@query("SELECT o_orderkey AS request, c_custkey AS key_id FROM orders JOIN customer ON sha256(c_name) = sha256('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'))")
def api_key_lookup(spark, sf):
    """Requests find their key by its hash."""
    keys = read(spark, sf, "customer").select(F.col("c_custkey").alias("key_id"), catalog.key_hash(F.col("c_name")).alias("key_hash"))
    asked = read(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), catalog.key_hash(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("key_hash"))
    return asked.join(keys, "key_hash").select("request", "key_id")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def audit_page(spark, sf):
    return catalog.page(read(spark, sf, "events").select("event_id", "ts", "event_type"), 50, 100, "ts", "event_id")


@query("SELECT embedding AS vector FROM embeddings")
def import_csv(spark, sf):
    lines = read(spark, sf, "embeddings").select(F.concat_ws(", ", F.col("embedding").cast("array<string>")).alias("value"))
    return imports.checked(imports.csv_vectors(lines))


@query("SELECT embedding AS vector, CAST(vec_id AS VARCHAR) AS external_id, '{\"label\":' || label || '}' AS metadata FROM embeddings")
def import_json(spark, sf):
    item = F.struct(F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("external_id"), F.concat(F.lit('{"label":'), "label", F.lit("}")).alias("metadata"))
    lines = read(spark, sf, "embeddings").groupBy("label").agg(F.to_json(F.collect_list(item)).alias("value"))
    return imports.checked(imports.json_vectors(lines))


@query("""WITH s AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ._-]', '', 'g'), '[ ._-]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM part),
n AS (SELECT p_partkey, CASE WHEN s = '' THEN 'tenant' ELSE s END AS s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) - 1 AS k FROM n)
SELECT p_partkey, CASE WHEN k > 0 THEN s || '-' || k ELSE s END AS slug FROM r""")
def slugify(spark, sf):
    return imports.unique_slugs(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("SELECT event_id AS lsn, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS type, CAST(user_id AS VARCHAR) AS doc_id, props AS metadata FROM events WHERE event_type <> 'signup'")
def wal_parse(spark, sf):
    """Log lines; sign-ups are written as broken lines, which don't count."""
    e = read(spark, sf, "events")
    entry = F.struct(F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("type"), F.col("user_id").cast("string").alias("doc_id"), F.col("props").alias("metadata"))
    lines = e.select(F.when(F.col("event_type") == "signup", F.concat(F.lit("["), "event_id", F.lit(',{"type":'))).otherwise(wal.line_of(F.col("event_id"), entry)).alias("value"))
    return wal.parsed(lines).select("lsn", "type", "doc_id", "metadata")


# ---------------------------------------------------- mutations, change log


def _log(spark, sf) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return read(spark, sf, "events").select(F.col("event_id").alias("lsn"), kind.alias("type"), F.col("user_id").alias("doc"), F.col("value").alias("val"))


@query("SELECT 2 * i.vec_id AS doc_id, e.vec_id IS NULL AS accepted FROM embeddings i LEFT JOIN embeddings e ON e.vec_id = 2 * i.vec_id")
def insert_unique(spark, sf):
    e = read(spark, sf, "embeddings")
    return collections.insert_outcome(e.select(F.col("vec_id").alias("doc_id")), e.select((2 * F.col("vec_id")).alias("doc_id")))


@query("SELECT vec_id AS doc_id, label FROM embeddings UNION ALL SELECT 2 * vec_id, label FROM embeddings WHERE 2 * vec_id NOT IN (SELECT vec_id FROM embeddings)")
def insert_batch(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return collections.insert_unique(e, e.withColumn("doc_id", 2 * F.col("doc_id")))


def _toxic_ids(spark, sf) -> DataFrame:
    return read(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_docs(spark, sf):
    return collections.delete(read(spark, sf, "documents").select("doc_id", "lang"), _toxic_ids(spark, sf))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def get_doc(spark, sf):
    return collections.get(read(spark, sf, "documents"), 7).select("doc_id", "lang", "n_chars")


@query("SELECT count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def count_docs(spark, sf):
    return collections.count(collections.soft_delete(read(spark, sf, "documents").select("doc_id"), _toxic_ids(spark, sf)))


@query("SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS lsn, o_orderkey FROM orders")
def wal_append(spark, sf):
    return changelog.append(_log(spark, sf), read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


LOG_SQL = "SELECT event_id AS lsn, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS type, user_id AS doc, value AS val FROM events"


@query(LOG_SQL)
def wal_replay(spark, sf):
    return changelog.replay(_log(spark, sf))


STATE_SQL = f"SELECT doc, lsn, val FROM ({LOG_SQL} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE type = 'upsert'"


@query(STATE_SQL)
def materialize_state(spark, sf):
    return changelog.materialize(_log(spark, sf), "doc")


@query(f"SELECT s.*, (SELECT max(event_id) + 1 FROM events) AS base_lsn FROM ({STATE_SQL}) s")
def compact(spark, sf):
    state, base = changelog.compacted(_log(spark, sf), "doc")
    return state.crossJoin(F.broadcast(base))


@query(STATE_SQL)
def recover(spark, sf):
    """A snapshot of the changes before 5000 and the log after it."""
    log = _log(spark, sf)
    return changelog.recover(changelog.materialize(log.where(F.col("lsn") < 5000), "doc"), log, 5000, "doc")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 10 AS kept FROM orders")
def wal_retention(spark, sf):
    return changelog.retained(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", group="o_custkey")


ENTRY_SQL = "16 + 4 * 64 + 100 + octet_length(encode(event_type)) + CASE WHEN props IS NULL THEN 0 ELSE 200 END"


def _entry() -> Column:
    return changelog.entry_bytes(F.lit(64), F.col("event_type"), F.col("props"))


@query(f"SELECT event_id, CAST({ENTRY_SQL} AS INTEGER) AS bytes FROM events")
def wal_size_estimate(spark, sf):
    return read(spark, sf, "events").select("event_id", _entry().cast("int").alias("bytes"))


@query(f"SELECT CAST(sum({ENTRY_SQL}) AS BIGINT) AS wal_bytes, count(*) FILTER (event_type <> 'error') AS inserts, sum({ENTRY_SQL}) >= 104857600 OR count(*) FILTER (event_type <> 'error') >= 10000 AS compact FROM events")
def should_compact(spark, sf):
    rows = read(spark, sf, "events").withColumn("type", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return changelog.should_compact(rows, _entry())


@query(f"SELECT user_id, {_micro('CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (event_type <> $$error$$) / count(*)::DOUBLE END')} AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf):
    missed = F.col("event_type") == "error"
    rows = read(spark, sf, "events").groupBy("user_id").agg(F.sum((~missed).cast("long")).alias("hits"), F.sum(missed.cast("long")).alias("misses"))
    return rows.select("user_id", micro(resilience.hit_rate(F.col("hits"), F.col("misses"))).alias("hit_rate"))


@query("""WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM documents UNION ALL SELECT '' FROM region)
SELECT CASE WHEN name IS NULL OR name = '' THEN 'empty' WHEN octet_length(encode(name)) > 255 THEN 'too long' WHEN contains(name, '..') THEN 'path traversal' WHEN regexp_matches(name, '[/\\\\\\x00]') THEN 'path separator'
  WHEN regexp_matches(name, '[<>:"|?*]') THEN 'reserved character' WHEN regexp_matches(name, '[\\x01-\\x1f\\x7f-\\x{9f}]') THEN 'control character' END AS problem, count(*) AS names FROM n GROUP BY 1""")
def validate_names(spark, sf):
    names = read(spark, sf, "pages").select(F.col("url").alias("name")).union(read(spark, sf, "part").select("p_name")).union(read(spark, sf, "documents").select("text")).union(read(spark, sf, "region").select(F.lit("")))
    return names.groupBy(catalog.name_problem(F.col("name")).alias("problem")).agg(F.count("*").alias("names"))


@query("SELECT count(*) AS documents, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS off_unit FROM embeddings")
def describe_collection(spark, sf):
    return collections.describe(read(spark, sf, "embeddings"))


def _stored(spark, sf):
    """A collection of the embeddings on disk."""
    docs = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("metadata"))
    found = Store(spark, work_path(spark, "store")).create("c", 64, "l2")
    found.insert(docs)
    return found, docs


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vector, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END AS metadata FROM embeddings")
def service_insert(spark, sf):
    """Inserted, then a third of the documents replaced."""
    found, docs = _stored(spark, sf)
    found.upsert(docs.where("int(doc_id) % 3 = 0").withColumn("metadata", F.lit("new")))
    return found.documents().select("doc_id", "vector", "metadata")


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(label AS VARCHAR) AS metadata FROM embeddings WHERE vec_id % 3 <> 1")
def service_delete(spark, sf):
    """Inserted, a third deleted, compacted."""
    found, docs = _stored(spark, sf)
    found.delete(docs.where("int(doc_id) % 3 = 1").select("doc_id"))
    found.compact()
    return found.documents().select("doc_id", "metadata")


@query("SELECT a.event_id, a.p IS NOT NULL AND (SELECT count(DISTINCT user_id) FROM events b WHERE b.event_id > a.p AND b.event_id < a.event_id) < 20 AS hit FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) a")
def cached_reads(spark, sf):
    """Reads by user through a cache of 20 entries."""
    return resilience.cached_reads(read(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 20).select("event_id", "hit")


# ----------------------------------------------------- tiering, resilience

STATES_SQL = "SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, user_id % 10 = 0 AS pinned, max(ts) AS last_accessed_at, count(*) AS access_count, max(ts) AS access_window_start FROM events GROUP BY user_id"
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _states(spark, sf) -> DataFrame:
    rows = tiering.access_stats(read(spark, sf, "events"), "user_id", "ts")
    third = F.col("user_id") % 3
    return rows.select("user_id", F.when(third == 0, "hot").when(third == 1, "warm").otherwise("cold").alias("tier"), (F.col("user_id") % 10 == 0).alias("pinned"), "last_accessed_at", "access_count", F.col("last_accessed_at").alias("access_window_start"))


@query("SELECT user_id, max(ts) AS last_accessed_at, count(*) AS access_count FROM events GROUP BY 1")
def access_stats(spark, sf):
    return tiering.access_stats(read(spark, sf, "events"), "user_id", "ts")


@query(f"SELECT user_id, count(*) FILTER (ts > {NOW_SQL} - INTERVAL 1 HOUR AND ts <= {NOW_SQL}) AS recent FROM events GROUP BY 1")
def access_window(spark, sf):
    return tiering.window_counts(read(spark, sf, "events"), "user_id", "ts", F.expr(NOW))


@query(f"SELECT * FROM ({STATES_SQL}) WHERE tier = 'hot' AND last_accessed_at < {NOW_SQL} - INTERVAL 6 HOUR AND NOT pinned")
def hot_idle(spark, sf):
    return tiering.idle_hot(_states(spark, sf), F.expr(NOW))


@query(f"SELECT * FROM ({STATES_SQL}) WHERE tier = 'warm' AND last_accessed_at < {NOW_SQL} - INTERVAL 7 DAY AND NOT pinned")
def warm_idle(spark, sf):
    return tiering.idle_warm(_states(spark, sf), F.expr(NOW))


@query(f"SELECT * FROM ({STATES_SQL}) WHERE tier = 'warm' AND access_window_start >= {NOW_SQL} - INTERVAL 1 HOUR AND access_count >= 10")
def promote_hot(spark, sf):
    return tiering.busy_warm(_states(spark, sf), F.expr(NOW))


CYCLE_SQL = f"""WITH a AS (SELECT *, CASE WHEN tier = 'hot' AND last_accessed_at < {NOW_SQL} - INTERVAL 6 HOUR AND NOT pinned THEN 'warm' ELSE tier END AS t1 FROM ({STATES_SQL})),
b AS (SELECT *, CASE WHEN t1 = 'warm' AND last_accessed_at < {NOW_SQL} - INTERVAL 7 DAY AND NOT pinned THEN 'cold' ELSE t1 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN t2 = 'warm' AND access_window_start >= {NOW_SQL} - INTERVAL 1 HOUR AND access_count >= 10 THEN 'hot' ELSE t2 END AS new_tier FROM b)"""


@query(f"{CYCLE_SQL} SELECT user_id, tier, new_tier FROM c")
def tiering_cycle(spark, sf):
    return tiering.cycle(_states(spark, sf), F.expr(NOW)).select("user_id", "tier", "new_tier")


@query(f"{CYCLE_SQL} SELECT new_tier, count(*) AS collections FROM c GROUP BY 1")
def tier_counts(spark, sf):
    return tiering.tier_counts(tiering.cycle(_states(spark, sf), F.expr(NOW)), "new_tier")


@query(f"SELECT user_id, tier, CASE WHEN user_id % 7 = 0 THEN true ELSE pinned END AS pinned FROM ({STATES_SQL})")
def pin(spark, sf):
    states = _states(spark, sf)
    return tiering.pinned(states, states.where("user_id % 7 = 0"), "user_id").select("user_id", "tier", "pinned")


@query(f"""{CYCLE_SQL} SELECT user_id, tier AS from_tier, new_tier AS to_tier, CASE WHEN new_tier = 'hot' THEN 'load' WHEN tier = 'hot' AND new_tier = 'cold' THEN 'write file and snapshot' WHEN new_tier = 'cold' THEN 'snapshot' WHEN tier = 'hot' THEN 'write file' ELSE 'restore' END AS action FROM c WHERE tier <> new_tier""")
def tier_moves(spark, sf):
    return tiering.moves(tiering.cycle(_states(spark, sf), F.expr(NOW)), "user_id")


@query("SELECT p_partkey, p IN ('memory', 'memory_s3', 's3_only') AS known, p IN ('memory', 'memory_s3') AS keeps_memory, p IN ('memory_s3', 's3_only') AS needs_store, p IN ('memory', 'memory_s3', 's3_only') AS needs_log FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'memory_s3' WHEN 2 THEN 's3_only' ELSE 'disk' END AS p FROM part)")
def storage_policy(spark, sf):
    quarter = F.col("p_size") % 4
    policy = F.when(quarter == 0, "memory").when(quarter == 1, "memory_s3").when(quarter == 2, "s3_only").otherwise("disk")
    return read(spark, sf, "part").select("p_partkey", *tiering.storage_flags(policy))


@query("""SELECT event_id, CASE WHEN m LIKE '%500%' OR m LIKE '%503%' OR m LIKE '%504%' OR m LIKE '%429%' OR m LIKE '%timeout%' OR m LIKE '%connection reset%' THEN 'transient' WHEN m LIKE '%403%' OR m LIKE '%404%' OR m LIKE '%400%' THEN 'permanent' ELSE 'transient' END AS class
FROM (SELECT event_id, 'status ' || CAST(400 + event_id % 110 AS VARCHAR) AS m FROM events)""")
def classify_errors(spark, sf):
    message = F.concat(F.lit("status "), (400 + F.col("event_id") % 110).cast("string"))
    return read(spark, sf, "events").select("event_id", resilience.error_class(message).alias("class"))


@query("SELECT event_id, CAST(least(1000 * pow(2, least(event_id % 40, 30)), 64000) AS BIGINT) AS wait_ms FROM events")
def backoff(spark, sf):
    return read(spark, sf, "events").select("event_id", resilience.backoff_ms(F.col("event_id") % 40).alias("wait_ms"))


@query(f"SELECT event_id, {_micro('avg(CASE WHEN event_type = $$error$$ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w')} AS error_rate, count(*) OVER w AS requests FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)")
def error_rate_60s(spark, sf):
    rows = resilience.error_rates(read(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", F.col("event_type") == "error")
    return rows.select("event_id", micro("error_rate").alias("error_rate"), "requests")


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, ts, row_number() OVER k AS rn, CAST(event_type = 'error' AS INTEGER) AS bad, sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, min(rn) OVER w AS lo, min(cum - bad) OVER w AS cum_lo FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 'closed' AS state, CAST(NULL AS TIMESTAMP) AS since, 0 AS good, CAST(0 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS cum_start FROM e
UNION ALL
SELECT user_id, rn, event_id, state, CASE WHEN state = 'open' AND found <> 'open' THEN ts ELSE since END, good, CASE WHEN state <> found AND found <> 'open' THEN rn ELSE start END, CASE WHEN state <> found AND found <> 'open' THEN cum ELSE cum_start END
FROM (SELECT *, CASE WHEN found = 'half_open' AND bad = 1 THEN 'open' WHEN found = 'half_open' AND good >= 10 THEN 'closed' WHEN found = 'closed' AND rn - greatest(start, lo - 1) >= 10 AND (cum - greatest(cum_start, cum_lo)) * 2 > rn - greatest(start, lo - 1) THEN 'open' ELSE found END AS state
  FROM (SELECT *, CASE WHEN found <> 'half_open' THEN good0 WHEN bad = 1 THEN good0 ELSE (CASE WHEN was = 'open' THEN 0 ELSE good0 END) + 1 END AS good
    FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, e.bad, e.cum, e.lo, e.cum_lo, r.state AS was, r.since, r.good AS good0, r.start, r.cum_start, CASE WHEN r.state = 'open' AND e.ts - r.since >= INTERVAL 300 SECOND THEN 'half_open' ELSE r.state END AS found FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))))
SELECT user_id, event_id, state FROM r WHERE rn > 0""")
def breaker_states(spark, sf):
    return resilience.breaker_states(read(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 10000")
def dlq_fifo(spark, sf):
    return resilience.newest(read(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", "ts"), "event_id")


@query(f"SELECT event_id, ts + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'error' AND ts + INTERVAL 7 DAY >= {NOW_SQL}")
def dlq_expire(spark, sf):
    rows = read(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return resilience.unexpired(rows, F.expr(NOW))


@query("SELECT event_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') AS taken FROM events WHERE event_type = 'error'")
def dlq_retry(spark, sf):
    """Letters whose document was stored meanwhile aren't inserted again."""
    letters = read(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id")
    again, taken = resilience.redriven(letters, read(spark, sf, "events").where("event_type = 'signup'"), "user_id")
    return again.select("event_id", F.lit(False).alias("taken")).union(taken.select("event_id", F.lit(True)))


@query(f"SELECT event_id, ts + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'error' AND ts + INTERVAL 7 DAY >= {NOW_SQL} + INTERVAL 1 DAY QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 500")
def dlq_persist(spark, sf):
    """A queue of 500 that was written and is read a day later."""
    letters = read(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    path, later = work_path(spark, "letters"), F.expr(NOW) + F.expr("INTERVAL 1 DAY")
    resilience.keep_letters(letters.limit(0), path, F.expr(NOW), "event_id", 500)
    resilience.keep_letters(letters.where(F.col("expires_at") >= later), path, F.expr(NOW), "event_id", 500)
    return resilience.kept_letters(spark, path, later)


@query("SELECT p_brand, count(*) > 0 AND bool_and(p_size < 50) AS ready FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY 1")
def readiness(spark, sf):
    """Two services, whose collections' breakers are open at size 50."""
    size = F.col("p_size")
    rows = read(spark, sf, "part").select("p_brand", F.when(size >= 50, "open").when(size >= 40, "half_open").otherwise("closed").alias("breaker"))
    one, two = (resilience.ready(rows.where(F.col("p_brand") == b)).select(F.lit(b).alias("p_brand"), "ready") for b in ("Brand#11", "Brand#12"))
    return one.union(two)


@query("SELECT event_type, count(*) AS uploads, CAST(sum(length(props)) AS BIGINT) AS bytes, max(ts) AS last_snapshot, max(value) AS worst FROM events GROUP BY 1")
def storage_rollup(spark, sf):
    rows = read(spark, sf, "events").select("event_type", F.lit(1).alias("uploads"), F.length("props").alias("bytes"), F.col("ts").alias("last_snapshot"), F.col("value").alias("worst"))
    return resilience.rollup(rows, ["uploads", "bytes"], ["last_snapshot", "worst"], ["event_type"])


@query("SELECT p_brand, CASE max(CASE WHEN p_size / 50.0 >= 0.9 THEN 2 WHEN p_size / 50.0 >= 0.75 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS health FROM part GROUP BY 1")
def health_rollup(spark, sf):
    rows = read(spark, sf, "part").select("p_brand", resilience.cache_health(F.col("p_size"), F.lit(50)).alias("health"))
    return resilience.worst_health(rows, ["p_brand"])


# --------------------------------------------------- security and embedding


def _users(spark, sf) -> DataFrame:
    segment = F.col("c_mktsegment")
    role = F.when(segment == "BUILDING", "admin").when(segment == "AUTOMOBILE", "developer").when(segment == "MACHINERY", "viewer").otherwise("auditor")
    return read(spark, sf, "customer").select("c_custkey", role.alias("role"), F.when(F.col("c_acctbal") < 0, "suspended").otherwise("active").alias("status"))


@query("""WITH u AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'AUTOMOBILE' THEN 'developer' WHEN 'MACHINERY' THEN 'viewer' ELSE 'auditor' END AS role, CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status FROM customer),
a AS (SELECT unnest([%s]) AS action)
SELECT c_custkey, role, status, action, status = 'active' AND (role = 'admin' OR role || ' ' || action IN (%s)) AS allowed FROM u, a""" % (", ".join(f"'{a}'" for a in catalog.ACTIONS), ", ".join(f"'{r} {a}'" for r, xs in catalog.ROLES.items() if r != "admin" for a in xs)))
def rbac_matrix(spark, sf):
    return catalog.permission_matrix(_users(spark, sf))


KEY_SQL = "CASE WHEN c_acctbal < 0 THEN 'key_' ELSE 'ak_' END || sha256(c_name)"


@query(f"""WITH k AS (SELECT c_custkey, {KEY_SQL} AS key, CASE WHEN c_nationkey % 3 > 0 THEN TIMESTAMP '2024-01-20' + to_days(CAST(c_nationkey AS INTEGER)) END AS expires, CASE WHEN c_mktsegment = 'BUILDING' THEN ['collection::read'] ELSE ['collection::read', 'document::search'] END AS permissions FROM customer)
SELECT c_custkey, length(key) = 67 AND starts_with(key, 'ak_') AS well_formed, CASE WHEN {NOW_SQL} > expires THEN 'expired' WHEN NOT list_contains(permissions, 'document::search') THEN 'not permitted' END AS problem FROM k""")
def api_key_check(spark, sf):
    key = F.concat(F.when(F.col("c_acctbal") < 0, "key_").otherwise("ak_"), catalog.key_hash(F.col("c_name")))
    expires = F.when(F.col("c_nationkey") % 3 > 0, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00' + make_dt_interval(c_nationkey)"))
    permissions = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("collection::read"))).otherwise(F.array(F.lit("collection::read"), F.lit("document::search")))
    return read(spark, sf, "customer").select("c_custkey", catalog.key_shape(key).alias("well_formed"), catalog.key_problem(expires, permissions, F.lit("document::search"), F.expr(NOW)).alias("problem"))


@query("SELECT s_suppkey, s_acctbal < 0 AS memory_unbounded, s_nationkey = 0 AS storage_unbounded, s_suppkey % 5 = 0 AS qps_unbounded FROM supplier")
def quota_flags(spark, sf):
    memory = F.when(F.col("s_acctbal") < 0, 0).otherwise(1 << 35)
    return read(spark, sf, "supplier").select("s_suppkey", *catalog.quota_flags(memory, F.col("s_nationkey"), F.col("s_suppkey") % 5))


@query()
def embed_mock(spark, sf):
    return embedding.embed(read(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, 1000000::BIGINT AS norm, CAST(64 AS INTEGER) AS dim, min(doc_id) OVER (PARTITION BY text) AS same_as FROM documents")
def embed_norms(spark, sf):
    """Embeddings have norm 1, and equal ones belong to equal texts."""
    from pyspark.sql import Window

    rows = embedding.embed(read(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", micro(F.round(vectors.norm("embedding"), 5)).alias("norm"), vectors.dimension("embedding").alias("dim"), F.min("doc_id").over(Window.partitionBy("embedding")).alias("same_as"))


@query("SELECT greatest(sum(CAST(floor(octet_length(encode(text)) / 4.0) AS BIGINT)), count(*))::BIGINT AS total_tokens FROM documents")
def token_estimate(spark, sf):
    return embedding.token_estimate(read(spark, sf, "documents"), "text")


# ------------------------------------------------------------------- metrics


def _window_sql(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, ts)"


BAD_SQL = "count(*) FILTER (event_type = 'error')"


@query(f"SELECT {_window_sql(60)} AS window_start, {BAD_SQL} AS bad, count(*) AS total, {_micro(f'{BAD_SQL} / count(*)::DOUBLE')} AS ratio, {BAD_SQL} / count(*)::DOUBLE > 0.05 AS firing FROM events GROUP BY 1")
def alert_error_ratio(spark, sf):
    return metrics.windowed_ratio(read(spark, sf, "events"), "ts", F.col("event_type") == "error", 60).withColumn("ratio", micro("ratio"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_p95(spark, sf):
    return metrics.exact_percentile(read(spark, sf, "events"), "value", 0.95, ("event_type",))


@query(f"SELECT event_type, {_micro('1e6::DOUBLE * regr_slope(value, epoch_us(ts) / 1e6::DOUBLE - 1700000000.0::DOUBLE)')} AS slope FROM events GROUP BY 1")
def metric_slope(spark, sf):
    rows = metrics.slopes(read(spark, sf, "events"), "ts", "value", ("event_type",))
    return rows.select("event_type", micro(F.col("slope") * 1e6).alias("slope"))


@query(f"SELECT {_micro('avg(CASE WHEN tier = $$hot$$ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share, avg(CASE WHEN tier = 'hot' THEN 1.0 ELSE 0.0 END) > 0.5 AS firing FROM ({STATES_SQL})")
def tier_imbalance(spark, sf):
    return metrics.share(_states(spark, sf), F.col("tier") == "hot", 0.5).withColumn("share", micro("share"))


@query(f"SELECT {_window_sql(60)} AS window_start, {_micro('sum(value) / 20000.0::DOUBLE')} AS share, sum(value) / 20000.0::DOUBLE > 0.85::DOUBLE AS firing FROM events GROUP BY 1")
def memory_pressure(spark, sf):
    return metrics.pressure(read(spark, sf, "events"), "ts", "value", 20_000, minutes=60).withColumn("share", micro("share"))


@query(f"SELECT {_window_sql(60)} AS window_start, event_type, coalesce(sum(value) > 50 AND max(ts) > min(ts) AND regr_slope(value, epoch_us(ts) / 1e6::DOUBLE - 1700000000.0::DOUBLE) > 0, false) AS firing FROM events GROUP BY 1, 2")
def dlq_growing(spark, sf):
    return metrics.growing(read(spark, sf, "events"), "ts", "value", minutes=60, by=("event_type",)).select("window_start", "event_type", "firing")


@query(f"SELECT {_window_sql(5)} AS window_start, event_type, {_micro('count(*) / 300::DOUBLE')} AS per_second FROM events GROUP BY 1, 2")
def request_rate(spark, sf):
    return metrics.request_rates(read(spark, sf, "events"), "ts", by=("event_type",)).withColumn("per_second", micro("per_second"))


BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


@query("SELECT event_type, b.le, count(value) FILTER (b.le IS NULL OR value <= b.le) AS count FROM events, (SELECT unnest([%s, NULL]) AS le) b GROUP BY 1, 2" % ", ".join(f"{b}::DOUBLE" for b in BOUNDS))
def latency_histogram(spark, sf):
    return metrics.bucket_counts(read(spark, sf, "events"), "value", BOUNDS, ("event_type",))


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"list_sort(list(value))[least(CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p{round(100 * p)}" for p in (0.5, 0.95, 0.99)) + " FROM events WHERE value IS NOT NULL GROUP BY 1")
def load_percentiles(spark, sf):
    return metrics.indexed_percentiles(read(spark, sf, "events"), "value", (0.5, 0.95, 0.99), ("event_type",))


@query(f"""WITH s AS (SELECT count(*) AS requests, {BAD_SQL} AS failures, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds, arg_min(value, (ts, value)) AS a, arg_max(value, (ts, value)) AS b FROM events)
SELECT requests, failures, {_micro('failures / requests::DOUBLE')} AS error_rate, {_micro('seconds')} AS seconds, {_micro('(requests - failures) / seconds')} AS per_second, {_micro('(b - a) * 60 / seconds')} AS slope_per_minute FROM s""")
def load_summary(spark, sf):
    rows = metrics.load_summary(read(spark, sf, "events"), "ts", "value", F.col("event_type") == "error")
    return rows.select("requests", "failures", *(micro(c).alias(c) for c in ("error_rate", "seconds", "per_second", "slope_per_minute")))
