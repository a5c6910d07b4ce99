"""Intermediate tables in the shared folder, written once and read by several later joins.

A staged table has a known size, so the planner broadcasts it or not by that size, and a lost executor
costs no recomputation of what lies before it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .sinks import shared_output_dir

_PATHS: list[str] = []  # written by this driver
_TABLES: dict[str, str] = {}  # names of those laid out by a key


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = shared_output_dir(spark, f"stage-{name}")
    _PATHS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stage``, laid out by ``key`` as a shuffle would: joins on it read the rows where they lie."""
    spark = df.sparkSession
    path = shared_output_dir(spark, f"stage-{name}")
    table = f"stage_{path.rsplit('/', 1)[1]}"
    _PATHS.append(path)
    _TABLES[path] = table
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("parquet.writer.version", "v2").option("path", path).saveAsTable(table)
    return spark.table(table)


def at_once(*jobs):
    """Results of several independent staging functions, their Spark jobs submitted side by side."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def staged_so_far() -> int:
    return len(_PATHS)


def drop_stages(spark: SparkSession, keep: int = 0) -> None:
    """Remove the tables that ``stage`` wrote, but for the first ``keep``; results that read them must have been
    written before."""
    while len(_PATHS) > keep:
        written = _PATHS.pop()
        if written in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(written)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
