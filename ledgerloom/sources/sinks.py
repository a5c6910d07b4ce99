"""Report sinks (A4): write a report as a partitioned table from the executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

FORMATS = ("parquet", "csv", "json", "orc")


def shared_output_dir(spark: SparkSession, name: str = "exports") -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, order: list[Column] | None = None) -> str:
    """Write ``df`` (optionally in report order, E15) as ``fmt`` files; every
    executor writes its own partition, the driver only commits."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    if order:
        df = df.orderBy(*order)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def ordered_for_sink(df: DataFrame, order: list[Column], drop: list[str] | None = None) -> DataFrame:
    """Apply a report's default order (a range-partitioned global sort)
    only where rows leave the engine, then drop helper keys."""
    out = df.orderBy(*order)
    return out.drop(*drop) if drop else out


def read_report(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(path)
