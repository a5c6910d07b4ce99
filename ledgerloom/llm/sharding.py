"""Operator 5, sharding: two-pass external shuffle.

Pass one scatters rows by a seeded hash into buckets that each fit in memory; pass two shuffles every
bucket (Spark's ``shuffle`` array function is a seeded Fisher-Yates) and writes it at the place that the
bucket sizes give it.  The concatenated buckets are a random order of all rows, and shard ``s`` is the
``s``-th of equal cuts of that order, so row counts differ by at most one.  DataFrame functions only.

The hash is of the seed, the id, the text and the row's own place: its file's name and its number in the file,
so that equal rows, however many, spread over all buckets, and the same files give the same order on any cluster.
Rows that come from no file have their place in their partition instead; the same partitions then give the same order.

Edge cases: a null text has no bytes (size 8); null ids are scattered like others; rows that are equal in
id and text stay separate rows; an empty table gives no rows; other columns travel in ``record`` unread.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_id


GROUP = 4096  # buckets whose starts are summed at once


def own_place(df: DataFrame) -> list[Column]:
    """Columns that tell a row from rows equal to it."""
    try:
        df.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def scatter(df: DataFrame, id_col: str, text_col: str, buckets: int, seed: int, record: list[str] | None = None) -> DataFrame:
    """Pass one: ``bucket`` and ``row`` (the id, then the record: all columns, or those named)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in record or df.columns])
    return df.select(F.pmod(hash_id(id_col, text_col, *own_place(df), seed=seed), F.lit(buckets)).alias("bucket"),
                     F.struct(F.col(id_col).alias("id"), kept.alias("record")).alias("row"))


def starts_of(scattered: DataFrame) -> DataFrame:
    """Where each bucket starts in the whole order: sums within groups of buckets, then over the groups."""
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_rows").over(before(Window.partitionBy("group").orderBy("bucket"))), F.lit(0))
    groups = counts.groupBy("group").agg(F.sum("n_rows").alias("n_group"))
    groups = groups.select("group", F.coalesce(F.sum("n_group").over(before(Window.orderBy("group"))), F.lit(0)).alias("first"))
    return counts.withColumn("inside", inside).join(groups, "group").select("bucket", (F.col("first") + F.col("inside")).alias("start"))


def external_shuffle(df: DataFrame, id_col: str, text_col: str, n_shards: int, seed: int = 17,
                     bucket_bytes: int = 16 << 20, record: list[str] | None = None) -> DataFrame:
    """Return ``record`` (the input row, or its columns named in ``record``), ``shard`` (0 to n_shards - 1) and
    ``slot`` (place in the shard, gapless from 0).

    ``bucket_bytes`` is the expected text volume of a bucket.  One aggregate row (row count and bytes)
    reaches the driver, to choose the number of buckets."""
    total = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).alias("bytes")).first()
    n, buckets = total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    scattered = scatter(df, id_col, text_col, buckets, seed, record)
    # pass two: sort the bucket (task retries then agree), shuffle it, place it
    shuffled = (scattered.repartition(buckets, "bucket").groupBy("bucket")
                .agg(F.sort_array(F.collect_list("row")).alias("rows"))
                .sortWithinPartitions("bucket")
                .select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows")))
    placed = (shuffled.join(starts_of(scattered), "bucket")
              .select("start", F.posexplode("rows").alias("at", "row"))
              .select((F.col("start") + F.col("at")).alias("place"), "row.record"))
    # shard s holds the places p with p * n_shards div n = s; its first place is ceil(s * n / n_shards)
    n = max(n, 1)
    shard = F.expr(f"(place * {n_shards}L) div {n}L")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("shard", shard)
            .select("record", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records, a folder for each shard, each file in slot order."""
    (sharded.select("shard", "slot", "record.*").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op5(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The contract's digest: law ``rows``."""
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return external_shuffle(docs, "doc_id", "text", n_shards, record=["doc_id", "text"]).select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
