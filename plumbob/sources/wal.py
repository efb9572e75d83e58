"""Log files: a JSON array ``[lsn, entry]`` on each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.schemas import CHANGE_ENTRY


#: A whole number (a cast would cut "1.5" and overflow quietly) and an object.
LINE = r"^\s*\[\s*(0|[1-9][0-9]{0,17})\s*,\s*(\{.*\})\s*\]\s*$"


def parsed(lines: DataFrame, value: str = "value", schema: str = CHANGE_ENTRY) -> DataFrame:
    """``(lsn, ...)`` of the lines that hold a number and a typed entry; an
    entry's own lsn (of a checkpoint) is ``checkpoint_lsn``.

    An entry is parsed once: it is made by a generator, into which no filter or
    column is copied.
    """
    line = F.col(value)
    entry = F.explode(F.array(F.from_json(F.regexp_extract(line, LINE, 2), schema)))
    rows = lines.select(F.regexp_extract(line, LINE, 1).alias("lsn"), entry.alias("e")).where("lsn <> '' AND e.type IS NOT NULL")
    return rows.select(F.col("lsn").cast("long").alias("lsn"), F.col("e.lsn").alias("checkpoint_lsn"), *(F.col(f"e.{c}") for c in rows.schema["e"].dataType.names if c != "lsn"))


def rejected(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that ``parsed`` leaves out."""
    line = F.col(value)
    ok = F.coalesce(line.rlike(LINE) & F.get_json_object(F.regexp_extract(line, LINE, 2), "$.type").isNotNull(), F.lit(False))
    return lines.where(~ok)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def line_of(lsn: Column, entry: Column) -> Column:
    """A change as a line of a log file."""
    return F.concat(F.lit("["), lsn.cast("string"), F.lit(","), F.to_json(entry), F.lit("]"))


def write(log: DataFrame, path: str, lsn: str = "lsn") -> None:
    entry = F.struct(*(c for c in log.columns if c != lsn))
    log.select(line_of(F.col(lsn), entry).alias("value")).write.mode("append").text(path)
