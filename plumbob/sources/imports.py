"""Import of vectors from JSON and CSV, and of tenants from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbob.errors import ValidationError

LEAST_DIM, MOST_DIM = 16, 4096


def csv_vectors(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(vector)`` of comma-separated numbers; blank lines are left out."""
    text = F.trim(F.col(value))
    return lines.where(text != "").select(F.transform(F.split(text, r"\s*,\s*"), lambda x: x.try_cast("float")).alias("vector"))


def json_vectors(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(vector, external_id, metadata)`` of texts that hold a JSON array of
    objects, or one object."""
    item = "STRUCT<vector: ARRAY<FLOAT>, external_id: STRING, metadata: STRING>"
    text = F.trim(F.col(value))
    items = F.when(F.substring(text, 1, 1) == "[", F.from_json(text, f"ARRAY<{item}>")).otherwise(F.array(F.from_json(text, item)))
    return lines.select(F.explode(items).alias("i")).select("i.*").where("vector IS NOT NULL")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return checked(csv_vectors(spark.read.text(path)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return checked(json_vectors(spark.read.text(path, wholetext=True)))


def checked(docs: DataFrame, vector: str = "vector") -> DataFrame:
    """``docs`` if all its vectors have one dimension within the bounds."""
    low, high = docs.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low is not None and (low != high or not LEAST_DIM <= low <= MOST_DIM):
        raise ValidationError(f"one dimension from {LEAST_DIM} to {MOST_DIM} expected, found {low} to {high}")
    return docs


def slug(name: Column) -> Column:
    """Lower-case letters and digits; runs of spaces, dots, underscores and
    hyphens become one hyphen, other characters go."""
    kept = F.regexp_replace(F.lower(name), "[^a-z0-9 ._-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "[ ._-]+", "-"), "^-|-$", "")


def unique_slugs(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with ``slug``; repeated slugs get -1, -2 ... in ``order``, names
    without letters the slug tenant."""
    rows = df.withColumn("slug", F.when(slug(F.col(name)) == "", "tenant").otherwise(slug(F.col(name))))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(order)) - 1
    return rows.withColumn("slug", F.when(n > 0, F.concat_ws("-", "slug", n.cast("string"))).otherwise(F.col("slug")))


def read_tenants(spark: SparkSession, path: str) -> DataFrame:
    """Tenants of all JSON files below a folder, with slugs and known states."""
    rows = spark.read.schema("tenant_id STRING, name STRING, status STRING").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(path)
    state = F.lower("status")
    return unique_slugs(rows.withColumn("status", F.when(state.isin("active", "suspended", "decommissioned", "provisioning"), state).otherwise("active")), "name", "tenant_id")
