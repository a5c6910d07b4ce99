"""Small constant tables built JVM-side (no Python RDD, no Python workers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """``VALUES``-style table: one generated row per tuple, typed by ``ddl``."""
    schema = _parse_datatype_string(ddl)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
