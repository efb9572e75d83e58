"""Collections, change log, snapshots, imports, catalog."""

import random

import pytest
from pyspark.sql import functions as F

from plumbob import errors, schemas
from plumbob.operators import catalog, changelog, collections
from plumbob.sources import imports, snapshots, wal

LOG = "lsn long, type string, doc_id string, v int"


def changes(seed, n=200, keys=20):
    rng = random.Random(seed)
    return [(i + 1, rng.choice(["upsert", "upsert", "delete", "checkpoint"]), f"d{rng.randrange(keys)}", rng.randrange(100)) for i in range(n)]


def brute_state(rows):
    state = {}
    for lsn, kind, key, v in sorted(rows):
        if kind == "upsert":
            state[key] = (lsn, v)
        elif kind == "delete":
            state.pop(key, None)
    return state


def as_state(df):
    return {r.doc_id: (r.lsn, r.v) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_order_free_and_recovery_equals_it(spark, seed):
    rows = changes(seed)
    want = brute_state(rows)
    shuffled = random.Random(seed).sample(rows, len(rows))
    log = spark.createDataFrame(shuffled, LOG)
    assert as_state(changelog.materialize(log)) == want
    snapshot = changelog.materialize(log.where("lsn < 90"))
    assert as_state(changelog.recover(snapshot, log, 90)) == want
    assert [r.lsn for r in changelog.replay(log, 150).collect()] == list(range(150, 201))
    state, base = changelog.compacted(log)
    assert base.first().base_lsn == 201 and as_state(state) == want


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert changelog.materialize(log).count() == 0
    assert changelog.compacted(log)[1].first().base_lsn == 1
    assert changelog.should_compact(log, F.lit(1)).first().compact is False
    assert [r.lsn for r in changelog.append(log, spark.createDataFrame([("b",), ("a",)], "k string"), "k").orderBy("lsn").collect()] == [1, 2]


def test_append_is_dense(spark):
    log = spark.createDataFrame([(7, "upsert", "a", 1)], LOG)
    got = changelog.append(log, spark.range(500).repartition(7), "id").orderBy("lsn").collect()
    assert [(r.lsn, r.id) for r in got] == [(8 + i, i) for i in range(500)]


def test_insert_delete(spark):
    have = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5), (None, 6)], "doc_id string, n int")
    assert sorted(r.doc_id for r in collections.insert_unique(have, new).collect()) == ["a", "b", "c"]
    with pytest.raises(errors.AlreadyExists):
        collections.insert_unique(have, new, strict=True)
    assert [r.doc_id for r in collections.delete(have, new).collect()] == ["a"]
    with pytest.raises(errors.NotFound):
        collections.delete(have, new, strict=True)
    assert {r.doc_id: r.n for r in collections.upsert(have, new.limit(2)).collect()} == {"a": 1, "b": 3, "c": 4}
    assert collections.count(collections.soft_delete(have, new)).first().documents == 1
    assert collections.get(have, "zz").count() == 0 and collections.cleared(have).count() == 0
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [0.0, 0.0])], "doc_id string, v array<float>")
    assert [r.doc_id for r in collections.insert_unique(v.limit(0), v, vector="v", dim=2, metric="cosine").collect()] == ["x"]
    with pytest.raises(errors.ValidationError):
        collections.insert_unique(v.limit(0), v, vector="v", dim=3, strict=True)


def test_wal_lines(spark, tmp_path):
    lines = ['[2,{"type":"upsert","doc_id":"a","vector":[1.0,2.5],"ts":"2024-01-01T00:00:00Z"}]', '[1,{"type":"delete","doc_id":"b"}]', '[3,{"type":"checkpoint","lsn":2}]', "[4,", "", "nonsense", '[1.5,{"type":"upsert"}]', "[6,{}]"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = wal.parsed(df).orderBy("lsn").collect()
    assert [(r.lsn, r.type, r.doc_id, r.vector) for r in got] == [(1, "delete", "b", None), (2, "upsert", "a", [1.0, 2.5]), (3, "checkpoint", None, None)]
    assert got[2].checkpoint_lsn == 2
    assert wal.rejected(df).count() == 5
    wal.write(wal.parsed(df).drop("checkpoint_lsn"), str(tmp_path / "log"))
    assert wal.read(spark, str(tmp_path / "log")).drop("checkpoint_lsn").orderBy("lsn").collect() == wal.parsed(df).drop("checkpoint_lsn").orderBy("lsn").collect()


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_snapshots(spark, tmp_path, format):
    path = str(tmp_path / "s")
    rows = [("a", [1.0, 0.5], None), ("b", [2.0, 0.1], '{"k": 1}')]
    docs = spark.createDataFrame(rows, "doc_id string, vector array<float>, metadata string")
    assert snapshots.manifests(spark, path).count() == 0
    one, two = snapshots.create(docs, path, "c1", format=format), snapshots.create(docs, path, "c2", format=format)
    assert snapshots.restore(spark, path, one, docs.schema).orderBy("doc_id").collect() == docs.collect()
    assert [r.snapshot_id for r in snapshots.listed(snapshots.manifests(spark, path), "c2").collect()] == [two]
    assert snapshots.verified(spark, path, one) and not snapshots.verified(spark, path, "none")
    m = snapshots.manifest(spark, path, one)
    assert (m.vector_count, m.dimension, m.format) == (2, 2, format) and m.size_bytes > 0
    snapshots.remove(spark, path, one)
    with pytest.raises(errors.NotFound):
        snapshots.restore(spark, path, one, docs.schema)
    for bad in (docs.limit(0), docs.union(spark.createDataFrame([("c", [1.0], None)], docs.schema))):
        with pytest.raises(errors.ValidationError):
            snapshots.create(bad, path, "c3", format=format)
    with pytest.raises(errors.SerializationError):
        snapshots.create(docs, path, "c3", format="csv")


def test_lost_rows_are_noticed(spark, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([("a", [1.0])], "doc_id string, vector array<float>")
    one = snapshots.create(docs, path, "c")
    docs.union(docs).write.mode("overwrite").parquet(f"{path}/data/{one}")
    with pytest.raises(errors.StorageError):
        snapshots.restore(spark, path, one, docs.schema)


def test_batches(spark, tmp_path):
    docs = spark.range(250).withColumn("c", F.when(F.col("id") < 240, "a").otherwise("b"))
    snapshots.write_batches(docs, str(tmp_path / "b"), "c", 100)
    assert len(list((tmp_path / "b" / "c=a").glob("*.parquet"))) == 3
    for bad in (dict(rows=0), dict(rows=10_001), dict(tasks=51)):
        with pytest.raises(errors.ValidationError):
            snapshots.write_batches(docs, str(tmp_path / "x"), "c", **bad)


def test_imports(spark, tmp_path):
    (tmp_path / "v.csv").write_text("\n".join(",".join(str(i + j) for j in range(16)) for i in range(3)) + "\n\n")
    assert imports.read_csv(spark, str(tmp_path / "v.csv")).count() == 3
    (tmp_path / "v.json").write_text('[{"vector": [' + ",".join("1" * 16) + '], "external_id": "e"}]')
    assert imports.read_json(spark, str(tmp_path / "v.json")).first().external_id == "e"
    (tmp_path / "bad.csv").write_text("1,2\n")
    with pytest.raises(errors.ValidationError):
        imports.read_csv(spark, str(tmp_path / "bad.csv"))
    names = spark.createDataFrame([(1, "Big Co."), (2, "big  co"), (3, "日本"), (4, "A_b-C")], "k int, n string")
    assert [r.slug for r in imports.unique_slugs(names, "n", "k").orderBy("k").collect()] == ["big-co", "big-co-1", "tenant", "a-b-c"]
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "a.json").write_text('{"tenant_id": "1", "name": "My Firm", "status": "SUSPENDED"}')
    row = imports.read_tenants(spark, str(tmp_path / "t")).first()
    assert (row.slug, row.status) == ("my-firm", "suspended")


def test_catalog(spark):
    names = [None, "", "a" * 256, "a..b", "a/b", "a|b", "a\x07b", "fine-name", "é" * 128]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(catalog.name_problem(F.col("n"))).collect()] == ["empty", "empty", "too long", "path traversal", "path separator", "reserved character", "control character", None, "too long"]
    catalog.check_collection("ok", 16)
    for bad in (("", 16), ("a/b", 16), ("ok", 15), ("ok", 4097), ("ok", 16, "m" * 257)):
        with pytest.raises(errors.ValidationError):
            catalog.check_collection(*bad)
    parent = spark.createDataFrame([(1,), (2,)], "t int")
    child = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "t int, name string")
    assert [r.name for r in catalog.orphans(child, parent, "t").collect()] == ["y"]
    assert sorted(r.name for r in catalog.cascaded(child, parent, "t").collect()) == ["y", "z"]
    assert {r.name: r.t for r in catalog.nulled(child, parent, "t").collect()} == {"x": None, "y": 3, "z": None}
    with pytest.raises(errors.InvalidState):
        catalog.require_parents(child, parent, "t")
    with pytest.raises(errors.AlreadyExists):
        catalog.require_unique(parent.union(parent), "t")
    users = spark.createDataFrame([("a", "admin", "active"), ("s", "admin", "suspended"), ("d", "developer", "active"), ("v", "viewer", "active"), ("u", "auditor", "active"), ("n", None, "active")], "u string, role string, status string")
    got = {r.u: r.n for r in catalog.permission_matrix(users).groupBy("u").agg(F.sum(F.col("allowed").cast("int")).alias("n")).collect()}
    assert got == {"a": 17, "s": 0, "d": 9, "v": 3, "u": 3, "n": 0}
    assert [r.t for r in catalog.page(parent, 1, 1, "t").collect()] == [1]


def test_schemas_parse(spark):
    for name in dir(schemas):
        if name.isupper():
            assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_equal_numbers_and_repeated_rows_are_determined(spark):
    rows = [(1, "upsert", "a", 1), (1, "upsert", "a", 3), (1, "delete", "a", 9), (2, "upsert", "b", 5), (2, "delete", "b", 6), (3, "delete", "b", 7), (1, "upsert", "a", 2)]
    for seed in range(3):
        log = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), LOG).repartition(3)
        assert as_state(changelog.materialize(log)) == {"a": (1, 3)}
    with_map = spark.createDataFrame(rows, LOG).withColumn("m", F.create_map(F.lit("k"), "v"))
    assert [(r.doc_id, r.v, r.m) for r in changelog.materialize(with_map).collect()] == [("a", 3, {"k": 3})]
    current = spark.createDataFrame([("x", 0)], "doc_id string, v int")
    for seed in range(3):
        more = spark.createDataFrame(random.Random(seed).sample([("y", 2), ("y", 1), ("y", 3), ("x", 5)], 4), "doc_id string, v int").repartition(3)
        assert sorted((r.doc_id, r.v) for r in collections.insert_unique(current, more).collect()) == [("x", 0), ("y", 1)]


def test_interrupted_removal_loses_no_other_snapshot(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "doc_id long, vector array<double>")
    path = str(tmp_path / "s")
    a, b, c = (snapshots.create(docs, path, "c") for _ in range(3))

    def broken(spark, target):
        raise OSError("interrupted")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_delete", broken)
        with pytest.raises(OSError):
            snapshots.remove(spark, path, b)
    assert {r.snapshot_id for r in snapshots.manifests(spark, path).collect()} == {a, c}
    assert snapshots.restore(spark, path, a, docs.schema).count() == 5 and not snapshots.verified(spark, path, b)
    with pytest.raises(errors.NotFound):
        snapshots.remove(spark, path, b)
    assert snapshots.sweep(spark, path) == 1 and snapshots.sweep(spark, path) == 0
    assert not (tmp_path / "s" / "data" / b).exists()
    snapshots.remove(spark, path, a)
    assert [r.snapshot_id for r in snapshots.manifests(spark, path).collect()] == [c]


def test_files_of_a_store(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(10).coalesce(1).write.parquet(source)
    snapshots.copy(spark, source, target)
    assert spark.read.parquet(target).count() == 10
    file = next((tmp_path / "b").glob("*.parquet"))
    listed = {r.path.rpartition("/")[2]: r.bytes for r in snapshots.files(spark, target).collect()}
    assert listed[file.name] == file.stat().st_size == snapshots.head(spark, str(file))[0]
    for f in (lambda: snapshots.head(spark, target + "/none"), lambda: snapshots.copy(spark, target + "/none", source + "2")):
        with pytest.raises(errors.NotFound):
            f()


def test_catalog_changes(spark):
    kind = "key_id int, name string, updated_at timestamp"
    base = spark.createDataFrame([(1, "a", None), (2, "b", None)], kind)
    assert catalog.created(base, spark.createDataFrame([(3, "c", None)], kind), "key_id", ("name",)).count() == 3
    for bad in [(1, "x", None)], [(4, "a", None)]:
        with pytest.raises(errors.AlreadyExists):
            catalog.created(base, spark.createDataFrame(bad, kind), "key_id", ("name",))
    new = spark.createDataFrame([(2, None)], "key_id int, name string")
    rows = {r.key_id: (r.name, r.updated_at is None) for r in catalog.updated(base, new, "key_id").collect()}
    assert rows == {1: ("a", True), 2: (None, False)}
    gone = spark.createDataFrame([(7,)], "key_id int")
    with pytest.raises(errors.NotFound):
        catalog.updated(base, gone.withColumn("name", F.lit("x")), "key_id")
    with pytest.raises(errors.NotFound):
        catalog.removed(base, gone, "key_id")
    with pytest.raises(errors.AlreadyExists):
        catalog.updated(base, new.union(new), "key_id")
    assert [r.key_id for r in catalog.removed(base, new.select("key_id"), "key_id").collect()] == [1]
