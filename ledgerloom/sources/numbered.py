"""Stored numbered reports (A5, C10): every file holds a range of ids, and a small table says which.

The report is written as ``operators.row_id.dense_row_id`` leaves it, so its files follow the ids.  A read of some
records opens only the files whose range holds one of them.  Ids follow the report's total order, so a report
over the same rows gets the same ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literal import literal_table
from ..operators.records import read_records
from .committed import commit, read_committed


def store_numbered(report: DataFrame, path: str) -> None:
    """Write a report that has a column ``id``, and one row for each of its files: ``file``, ``lo``, ``hi``."""
    commit(report, f"{path}/rows")
    rows = read_committed(report.sparkSession, f"{path}/rows")
    ranges = rows.select("id", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"))
    commit(ranges.coalesce(1), f"{path}/ids")


def files_of(spark: SparkSession, path: str, ids: list[int]) -> list[str]:
    """The files that hold some of these ids: at most one for each id."""
    if not ids:
        return []
    asked = F.array(*[F.lit(int(i)).cast("long") for i in ids])
    inside = F.exists(asked, lambda i: i.between(F.col("lo"), F.col("hi")))
    return sorted(r["file"] for r in read_committed(spark, f"{path}/ids").where(inside).select("file").collect())


def read_stored(spark: SparkSession, path: str, ids: list[int], fields: list[str],
                refs: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``read_records`` over a stored report: one row for each id asked for, in that order."""
    schema = read_committed(spark, f"{path}/rows").schema
    files = files_of(spark, path, ids)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    asked = literal_table(spark, [(k + 1, int(i)) for k, i in enumerate(ids)], "pos long, id long")
    return read_records(rows.where(F.col("id").isin([int(i) for i in ids])), asked, fields, refs)
