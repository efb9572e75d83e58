"""Every query with SQL gives DuckDB's rows; the others keep their promises."""

import pytest

import compare
from plumbob.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare.differences(spark, SF, QUERIES[name], ORACLE[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["ann_ivf", "ann_lsh"])
def test_ann_recall(spark, name):
    exact = {(r.query_id, r.doc_id): r.score for r in QUERIES["knn_batch"](spark, SF).collect()}
    rows = QUERIES[name](spark, SF).collect()
    found = {(r.query_id, r.doc_id): r.score for r in rows}
    assert len(found) == len(rows) and len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(abs(exact[p] - found[p]) <= 1 for p in exact.keys() & found.keys())


def test_breaker_and_embedding_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert QUERIES["breaker_states"](spark, SF).count() == events
    rows = QUERIES["embed_mock"](spark, SF).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


def test_plans(spark, capsys):
    QUERIES["knn_cosine"](spark, SF).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
    QUERIES["get_doc"](spark, SF).explain()
    out = capsys.readouterr().out
    assert "EqualTo(doc_id,7)" in out and "text" not in out.split("ReadSchema")[1]
    QUERIES["knn_batch"](spark, SF).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
