import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbob import errors
from plumbob.operators import ann, search
from plumbob.store import Store

DOCS = "doc_id string, vector array<float>, metadata string"


def docs(spark, ids, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist(), f'{{"n": "{i}"}}') for i in ids], DOCS)


def test_life_of_a_collection(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.collections().count() == 0
    c = store.create("notes", 16)
    with pytest.raises(errors.AlreadyExists):
        store.create("notes", 16)
    with pytest.raises(errors.ValidationError):
        store.create("no/tes", 16)
    with pytest.raises(errors.NotFound):
        store.collection("other")
    assert c.count() == 0 and c.get("a") is None
    c.compact()
    first = docs(spark, "abcd")
    c.insert(first)
    assert c.count() == 4 and c.get("b").metadata == '{"n": "b"}'
    with pytest.raises(errors.AlreadyExists):
        c.insert(docs(spark, "xa"))
    with pytest.raises(errors.ValidationError):
        c.insert(docs(spark, "y", 8))
    assert c.count() == 4  # nothing of a refused batch
    c.delete(spark.createDataFrame([("a",)], "doc_id string"))
    with pytest.raises(errors.NotFound):
        c.delete(spark.createDataFrame([("a",)], "doc_id string"))
    before = sorted(c.documents().collect())
    c.compact()
    assert sorted(c.documents().collect()) == before and c.log().count() == 0
    c.upsert(docs(spark, "ab", seed=5))
    c.delete(spark.createDataFrame([("c",), ("zz",)], "doc_id string"), strict=False)
    c = Store(spark, str(tmp_path / "s")).collection("notes")  # as after a restart
    assert sorted(r.doc_id for r in c.documents().collect()) == ["a", "b", "d"]
    lsn = [r.lsn for r in c.log().orderBy("lsn").collect()]
    assert lsn == list(range(6, 10))
    q = c.get("d").vector
    assert c.search(q, 2).first().doc_id == "d" and c.search(q, 9).count() == 3
    with pytest.raises(errors.ValidationError):
        c.search([0.0] * 16, 2)
    batch = c.search_batch(c.documents().select(F.col("doc_id").alias("query_id"), "vector"), 1)
    assert {(r.query_id, r.doc_id) for r in batch.collect()} == {(x, x) for x in "abd"}
    assert not c.should_compact() and c.describe().first().dimension == 16
    assert [r.name for r in store.collections().collect()] == ["notes"]
    store.drop("notes")
    assert store.collections().count() == 0 if not (tmp_path / "s").exists() else not list((tmp_path / "s").glob("notes"))


def test_stored_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 300)] + 0.05 * rng.normal(size=(300, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ann.build_cells(d, str(tmp_path / "i"), ann.Cells(8, 2))
    q = d.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = search.top_k_batch(d, q, 5)
    found = ann.search_cells(spark, str(tmp_path / "i"), q, 5, 3)
    assert search.recall(exact, found, 5).agg(F.avg("recall")).first()[0] >= 0.9
    one = ann.search_cells(spark, str(tmp_path / "i"), q.limit(1), 5, 1)
    assert one.count() == 5
