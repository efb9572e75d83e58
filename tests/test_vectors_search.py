import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbob.errors import ValidationError
from plumbob.functions import vectors as V
from plumbob.operators import ann, search

VEC = "doc_id long, embedding array<double>"


def docs(spark, rows):
    return spark.createDataFrame(rows, VEC)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_hand_computed(spark):
    a, b = V.literal([3, 4]), V.literal([0, 0])
    assert one(spark, V.l2(a, b)) == 5
    assert one(spark, V.dot(a, a)) == 25
    assert one(spark, V.cosine(a, b)) == 0
    assert one(spark, V.cosine(a, V.literal([6, 8]))) == pytest.approx(1)
    assert one(spark, V.normalized(a)) == [0.6, 0.8]
    assert one(spark, V.normalized(b)) == [0, 0]
    assert one(spark, V.dot(a, V.literal([1]))) is None
    assert one(spark, V.cosine_of_distance(F.lit(math.sqrt(2)))) == pytest.approx(0)
    assert one(spark, V.bad_element(V.literal([1, float("nan"), float("inf")]))) == 1
    assert one(spark, V.off_unit(a)) is True


def test_problems(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [float("inf"), 0.0]), (4, [0.0, 0.0]), (5, None)]
    got = {r.doc_id: r.problem for r in V.validated(docs(spark, rows), "embedding", 2, "cosine").collect()}
    assert got == {1: None, 2: "dimension 2 expected, found 1", 3: "element 0 isn't finite", 4: "zero vector", 5: "null vector"}
    with pytest.raises(ValidationError):
        V.Metric.of("taxicab")


def test_top_k(spark):
    d = docs(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None)])
    assert [(r.doc_id, r.score) for r in search.top_k(d, [0, 0], 5, "l2", "doc_id").collect()] == [(1, 0), (3, 1), (2, 5)]
    line = docs(spark, [(i, [float(i), 1.0]) for i in range(1, 11)])
    assert search.top_k(line, [5, 1], 3, "cosine", "doc_id").first().doc_id == 5
    ties = docs(spark, [(9, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0])])
    assert [r.doc_id for r in search.top_k(ties, [1, 0], 2, "dot", "doc_id").collect()] == [3, 5]
    assert search.top_k(docs(spark, []), [1, 0], 2, "dot", "doc_id").count() == 0
    for bad in (dict(k=0), dict(k=10_001), dict(query=[0, 0]), dict(query=[float("nan"), 1]), dict(query=[])):
        with pytest.raises(ValidationError):
            search.top_k(line, bad.get("query", [1, 0]), bad.get("k", 1), "cosine", "doc_id")


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("sent", [True, False])
def test_batch_is_the_single_search(spark, monkeypatch, metric, sent):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)).round(1)
    x[20:30] = x[10:20]  # ties
    d = docs(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    if not sent:
        monkeypatch.setattr(search, "SENT_NUMBERS", 0)
        monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    q = d.select((F.col("doc_id")).alias("query_id"), "embedding").where("query_id < 20")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.top_k_batch(d, q, 4, metric, "doc_id").collect()}
    assert len(got) == 80
    for i in range(0, 20, 7):
        assert [got[i, r] for r in range(1, 5)] == [r.doc_id for r in search.top_k(d, x[i], 4, metric, "doc_id").collect()]


def test_batch_of_odd_rows(spark):
    d = docs(spark, [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1e-9])])
    q = docs(spark, [(7, [1.0, 0.0])]).withColumnRenamed("doc_id", "query_id")
    got = [(r.doc_id, r.score) for r in search.top_k_batch(d, q, 3, "l2", "doc_id").orderBy("rank").collect()]
    assert got == [(1, 0.0), (5, 1e-9), (4, 1.0)]
    assert search.top_k_batch(d.limit(0), q, 3, "cosine", "doc_id").count() == 0
    assert search.top_k_batch(d, q.limit(0), 3, "cosine", "doc_id").count() == 0
    with pytest.raises(ValidationError):
        search.top_k_batch(d, q.union(spark.createDataFrame([(8, [1.0])], q.schema)), 3, "l2", "doc_id")


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 400)] + 0.1 * rng.normal(size=(400, 24))
    d = docs(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    q = d.where("doc_id < 40").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = search.top_k_batch(d, q, 5, "l2", "doc_id")
    for f, kind in ((ann.ann_cells, "fast"), (ann.ann_planes, "fast")):
        got = search.recall(exact, f(d, q, 5, "l2", kind, key="doc_id"), 5).agg(F.avg("recall")).first()[0]
        assert got >= 0.9
    with pytest.raises(ValidationError):
        ann.ann_cells(d, q, 5, "l2", "slow", key="doc_id")


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("cut", [False, True])
def test_whole_probes_are_the_exact_search(spark, monkeypatch, metric, cut):
    """All cells, or all buckets, probed: ties, hot cells and shares included."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6)).round(1)
    x[30:60] = x[:1]  # one vector is a third of all
    d = docs(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    q = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    if cut:
        monkeypatch.setattr(ann, "PART_ROWS", 5)
        monkeypatch.setattr(ann, "GROUP_NUMBERS", 60)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    want = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in search.top_k_batch(d, q, 7, metric, "doc_id").collect()}
    for f, size in ((ann.ann_cells, ann.Cells(9, 9)), (ann.ann_planes, ann.Planes(2, 2, 4))):
        got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in f(d, q, 7, metric, size, "doc_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[p][1] - want[p][1]) < 1e-8 for p in want)
        assert sum(got[p][0] == want[p][0] for p in want) >= 0.98 * len(want)


def test_odd_rows_of_approximate_search(spark):
    d = docs(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, None)])
    q = docs(spark, [(7, [1.0, 0.0]), (8, [1.0]), (9, None)]).withColumnRenamed("doc_id", "query_id")
    for f in (ann.ann_cells, ann.ann_planes):
        assert [(r.query_id, r["rank"], r.doc_id) for r in f(d, q, 3, "l2", key="doc_id").orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
        assert f(d.limit(0), q, 3, "l2", key="doc_id").count() == 0
        assert f(d, q.limit(0), 3, "l2", key="doc_id").count() == 0
        with pytest.raises(ValidationError):
            f(d.union(docs(spark, [(4, [1.0])])), q, 3, "l2", key="doc_id")


def test_fewer_cells_for_clusters(spark):
    """What is searched follows the data and the wanted recall."""
    rng = np.random.default_rng(2)
    tight = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 16))
    loose = rng.normal(size=(2000, 16))
    few, many = (ann.cell_index(x, 2000, 10, V.Metric.L2, ann.Cells()) for x in (tight, loose))
    assert few.count == many.count == 45 and few.probes < 10 < many.probes
    assert ann.cell_index(tight, 10**8, 10, V.Metric.L2, ann.Cells()).count == 250  # as many as the sample bears
    keys = [ann.plane_index(x, 2000, 10, V.Metric.L2, ann.Planes()) for x in (tight, loose)]
    share = [k.probes / (1 << k.bits) for k in keys]
    assert share[0] < share[1]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_pairwise_in_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(V, "PAIR_BLOCK", 3)
    rows = [(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(20)] + [(30, [1.0]), (31, None), (32, [0.0, 0.0, 0.0]), (33, []), (34, [2.0])]
    d = docs(spark, rows)
    a, b = d.select(F.col("doc_id").alias("a"), F.col("embedding").alias("x")), d.select(F.col("doc_id").alias("b"), F.col("embedding").alias("y"))
    want = {(r.a, r.b): r.s for r in a.join(b, F.col("a") < F.col("b")).select("a", "b", V.Metric.of(metric).score("x", "y").alias("s")).collect()}
    rows = V.pairwise(d, "doc_id", "embedding", metric).collect()
    got = {(r.a, r.b): r.score for r in rows}
    assert len(rows) == len(got) == len(want) == 300
    assert all((got[p] is None) == (want[p] is None) and (got[p] is None or abs(got[p] - want[p]) < 1e-9) for p in want)
    assert V.pairwise(d.limit(0), "doc_id", "embedding", metric).count() == 0


def test_pooling(spark):
    t = spark.createDataFrame([("a", 0, 1, [1.0, 2.0]), ("a", 1, 1, [3.0, 4.0]), ("a", 2, 0, [9.0, 9.0]), ("b", 5, 1, [7.0, 7.0])], "k string, pos int, m int, v array<double>")
    assert {r.k: r.v for r in V.mean_pooled(t, "k", "v", "m").collect()} == {"a": [2, 3], "b": [7, 7]}
    assert {r.k: r.v for r in V.first_pooled(t, "k", "v", "pos").collect()} == {"a": [1, 2], "b": [7, 7]}


def test_what_a_search_holds_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(4)
    kinds = {m: rng.normal(size=(1000, 8)).astype(np.float32) for m in ("cosine", "l2", "dot")}
    for m, q in kinds.items():
        v = np.concatenate([rng.normal(size=(60_000, 8)), np.repeat(q[:50], 20, 0)]).astype(np.float32)  # ties, too
        tracemalloc.start()
        a, b, score = search.closest(search.Points(q, search.Metric.of(m)), search.Points(v, search.Metric.of(m)), 5)
        assert tracemalloc.get_traced_memory()[1] < 150e6  # a block's scores alone were 480 MB
        tracemalloc.stop()
        assert len(a) == 5000
        for i in (0, 3, 999):
            x, y = q[i].astype(float), v.astype(float)
            want = np.linalg.norm(y - x, axis=1) if m == "l2" else y @ x / (np.linalg.norm(x) * np.linalg.norm(y, axis=1) if m == "cosine" else 1)
            order = np.lexsort((np.arange(len(v)), np.round(want if m == "l2" else -want, 12)))[:5]
            assert b[a == i].tolist() == order.tolist()
            assert np.allclose(score[a == i], want[order], atol=1e-12)
    big = search.Points(np.array([[1e30, 0.0], [0.0, 1e-30]]), search.Metric.DOT)
    assert search.closest(big, big, 1)[1].tolist() == [0, 1]


def test_pairs_send_each_vector_a_few_times(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    plan = V.pairwise(rows, "doc_id", "embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert ", 42), 4) as int) AS own" in plan  # 4 blocks, 30 before
    assert "array<double>" not in plan
    assert V.pairwise(rows.limit(3000), "doc_id", "embedding").agg(F.count("*"), F.countDistinct("a")).first()[:] == (3000 * 2999 // 2, 2999)
