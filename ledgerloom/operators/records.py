"""Record reads over a numbered report (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_records(report: DataFrame, ids: DataFrame, fields: list[str],
                 refs: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Project ``fields`` for the requested ``ids`` (columns ``pos``, ``id``).

    Every requested id yields one row in ``pos`` order, with NULL fields when
    the report has no such id.  Each reference field in ``refs`` (field ->
    (dimension, display column)) becomes ``struct<id, display_name>``, NULL
    when the reference is empty (NULL or key 0).  Joins only: nothing is collected."""
    refs = refs or {}
    x = ids.select("pos", "id").join(report.select("id", *fields), "id", "left")
    for f, (dim, name_col) in refs.items():
        d = dim.select(F.col("id").alias(f"_{f}_id"), F.col(name_col).alias(f"_{f}_name"))
        x = (x.join(d, F.col(f) == F.col(f"_{f}_id"), "left")
             .withColumn(f, F.when(F.col(f) != 0,
                                   F.struct(F.col(f).alias("id"), F.col(f"_{f}_name").alias("display_name"))))
             .drop(f"_{f}_id", f"_{f}_name"))
    return x.select("pos", "id", *fields).orderBy("pos")
