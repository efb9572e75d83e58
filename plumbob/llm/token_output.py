"""Operator 10 - token ids as Parquet lists for selective reads.

Documents are tokenised by a public byte-level BPE (its vocabulary file is a
parameter and must be readable by all executors), or come with ready ids
(``store_ids``), and are written in the order of
``doc_id``: files hold ranges of ids, sorted, in row groups of at most
``GROUP_BYTES`` and pages of at most ``PAGE_ROWS`` documents.  Token ids are a
list column with dictionary encoding (the dictionary page holds 2**18 ids, so
any usual vocabulary; beyond it Parquet writes plain values); ``doc_id`` and
``n_tokens`` are delta-encoded; Parquet's page indexes are written.  All other
columns but ``text`` stay beside them.  So a read of metadata touches narrow
columns only, and a read of some ids skips files, row groups and pages by their
bounds.

One shuffle moves the texts into their ranges; tokens are made after it, in
the tasks that write them, and only texts and ids cross to Python.

Rows are kept as they are, repeated ones too; null ids come first, a null text
has null ``token_ids`` and ``n_tokens``, an empty one has an empty list.
Columns called ``token_ids`` or ``n_tokens`` before are replaced.  An empty
input gives an empty dataset with its schema.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import list_array, require, table, tuned, work_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Input bytes whose tokens make one file.
FILE_BYTES = 64 << 20
GROUP_BYTES = 16 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2000
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

_encodings: dict[str, object] = {}


def encoding(path: str):
    """A vocabulary's encoder, one for each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens`` and ``token_ids``."""
    require(docs, "doc_id", "text")
    tuned(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoding(vocabulary).encode_to_numpy
        none = np.zeros(0, np.uint32)
        lists = list_array([encode(t, disallowed_special=()) if t else none for t in texts.to_pylist()], pa.int32())
        return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=texts.is_null())

    other = [c for c in docs.columns if c.lower() not in ("text", "token_ids", "n_tokens")]
    rows = docs.select(*other, ids(F.col("text").cast("string")).alias("token_ids"))
    return rows.select(*other, F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "token_ids")


def in_order(df: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``df`` in ranges of ``doc_id``, one for each file, and sorted in each.

    The number of files follows the optimiser's estimate of the input's size,
    which for files needs no job; where it knows nothing, ids are counted.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = 2000 * df.count()
    return df.repartitionByRange(max(1, math.ceil(size / file_bytes)), "doc_id").sortWithinPartitions("doc_id")


def write_tokens(rows: DataFrame, path: str, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write ``(doc_id, n_tokens, token_ids, ...)`` as it is ordered."""
    require(rows, "doc_id", "n_tokens", "token_ids")
    rows.write.options(**OPTIONS | {"parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": str(page_rows)}).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: Iterable[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The dataset, or the documents of some ids or of a range (both ends in)."""
    rows = spark.read.parquet(path)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin([int(i) for i in ids]))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the token ids."""
    return spark.read.parquet(path).drop("token_ids")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, documents, tokens, first_id, last_id)``, without token ids read."""
    rows = read_metadata(spark, path).select(F.input_file_name().alias("file"), "doc_id", "n_tokens")
    return rows.groupBy("file").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` again."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        decode = encoding(vocabulary).decode
        return pa.array([None if x is None else decode(x) for x in ids.to_pylist()], pa.string())

    return rows.select("doc_id", text("token_ids").alias("text"))


def tokens_of(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise texts, write them to ``path`` and return the dataset there."""
    require(docs, "doc_id", "text")
    write_tokens(tokenised(in_order(docs, file_bytes), vocabulary), path)
    return read_tokens(docs.sparkSession, path)


def store_ids(encoded: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The same for ready ids, such as the SentencePiece operator's: write rows
    that have ``doc_id`` and ``token_ids`` and return the dataset."""
    require(encoded, "doc_id", "token_ids")
    other = [c for c in encoded.columns if c.lower() not in ("doc_id", "token_ids", "n_tokens", "text")]
    ids = F.col("token_ids").cast("array<int>")
    rows = encoded.select("doc_id", *other, F.when(ids.isNotNull(), F.size(ids)).alias("n_tokens"), ids.alias("token_ids"))
    write_tokens(in_order(rows, file_bytes), path)
    return read_tokens(encoded.sparkSession, path)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"), work_path(spark, "tokens"))
