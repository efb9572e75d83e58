import pyarrow.parquet as pq
from pyspark.sql import functions as F

import odd
from plumbob.llm import token_output as T

SF = "/root/testdata/sf0.001"


def files(path):
    return sorted(path.glob("*.parquet"))


def test_layout_and_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = tmp_path / "t"
    got = T.tokens_of(docs.repartition(5), str(path), file_bytes=200_000)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"]
    back = T.decoded(got).withColumnRenamed("text", "t").join(docs, "doc_id")
    assert back.count() == docs.count() and back.where("t <> text").count() == 0
    bounds = []
    for f in files(path):
        m = pq.ParquetFile(f).metadata
        columns = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for i in range(m.num_columns)}
        tokens = columns["token_ids.list.element"]
        assert "RLE_DICTIONARY" in tokens.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values() if c is not tokens) and tokens.has_offset_index
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        bounds.append((ids[0], ids[-1]))
    assert len(bounds) > 1 and all(a[1] < b[0] for a, b in zip(sorted(bounds), sorted(bounds)[1:]))
    m = T.manifest(spark, str(path)).collect()
    assert sorted((r.first_id, r.last_id) for r in m) == sorted(bounds) and sum(r.documents for r in m) == docs.count()


def test_row_groups(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS doc_id", "200 AS n_tokens", "transform(sequence(1, 200), x -> int(pmod(hash(id, x), 50000))) AS token_ids")
    T.write_tokens(rows.coalesce(1), str(tmp_path / "t"), group_bytes=200_000, page_rows=100)
    assert pq.ParquetFile(files(tmp_path / "t")[0]).metadata.num_row_groups > 2


def test_selective_reads(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    T.tokens_of(spark.read.parquet(f"{SF}/documents.parquet"), path)
    some = T.read_tokens(spark, path, ids=[3, 77])
    assert sorted(r.doc_id for r in some.collect()) == [3, 77]
    assert T.read_tokens(spark, path, low=10, high=12).count() == 3
    some.explain()
    T.read_metadata(spark, path).explain()
    first, second = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert "In(doc_id, [3,77])" in first and "token_ids" not in second.split("ReadSchema")[1]


def test_odd_documents(spark, tmp_path):
    docs = odd.documents(spark).withColumn("TOKEN_IDS", F.lit("old"))
    got = T.tokens_of(docs, str(tmp_path / "t"))
    assert [c for c in got.columns if c not in ("n_tokens", "token_ids")] == [c for c in docs.columns if c not in ("text", "TOKEN_IDS")]
    rows = got.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].token_ids is None and by[3].n_tokens is None and by[4].token_ids == [] and by[4].n_tokens == 0
    want = sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in T.decoded(got).collect()) == want
    assert T.tokens_of(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_query(spark):
    encoding = T.encoding(T.VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = T.op10_token_output(spark, SF).collect()
    assert len(got) == len(texts) and all(r.token_ids == encoding.encode_ordinary(texts[r.doc_id]) for r in got)


def test_ready_ids(spark, tmp_path):
    """SentencePiece ids, whole and in order, with null and empty texts."""
    from plumbob.llm import pieces

    docs = odd.documents(spark).where("doc_id IS NULL OR doc_id <> 7")
    encoded = pieces.encode(docs)
    want = sorted(((r.doc_id, r.token_ids, r.n_tokens) for r in encoded.collect()), key=repr)
    got = T.store_ids(encoded, str(tmp_path / "t"), 1 << 12)
    assert got.columns == ["doc_id", "restored", "n_tokens", "token_ids"]
    assert sorted(((r.doc_id, r.token_ids, r.n_tokens) for r in got.collect()), key=repr) == want
    assert T.store_ids(encoded.limit(0), str(tmp_path / "e")).count() == 0
