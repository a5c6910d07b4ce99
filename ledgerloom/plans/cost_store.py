"""The stored cost of order lines (G1): built once, then refreshed where its inputs changed.

A line's cost is taken when its product or its order's state changes, and kept otherwise, also when the
product's price changes later.  The store keeps those two inputs beside the cost, in buckets of the line id.
A refresh compares stored inputs with current ones by key, computes the cost of the changed and new lines alone,
and commits the buckets that hold them; all other buckets keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.committed import commit, current, read_committed
from ..sources.staging import stage
from .common import Tables
from .enrich import cost_snapshot

COLUMNS = ["line_id", "product_id", "order_state", "purchase_price", "bucket"]
BUCKETS = 64


def current_inputs(T: Tables, buckets: int) -> DataFrame:
    """What the cost of every line hangs on now."""
    orders = T["sale_order"].select(F.col("id").alias("order_id"), F.col("state").alias("order_state"))
    return (T["sale_order_line"].select(F.col("id").alias("line_id"), "order_id", "product_id").join(orders, "order_id", "left")
            .select("line_id", "product_id", "order_state", F.pmod(F.xxhash64("line_id"), F.lit(buckets)).cast("int").alias("bucket")))


def _costed(inputs: DataFrame, products: DataFrame, company: str | int) -> DataFrame:
    cost = cost_snapshot(inputs.select(F.col("line_id").alias("id"), "product_id"), products, company).select("line_id", "purchase_price")
    return inputs.join(cost, "line_id").select(*COLUMNS)


def build(T: Tables, path: str, company: str | int, buckets: int = BUCKETS) -> None:
    """Take the cost of every line now."""
    rows = _costed(current_inputs(T, buckets), T["product_product"], company)
    commit(rows.repartition(buckets, "bucket"), path, ["bucket"])


def changes(T: Tables, stored: DataFrame, buckets: int) -> DataFrame:
    """Lines whose stored inputs differ from the current ones, lines not stored yet, and (``gone``) stored lines
    that no longer exist."""
    now, old = current_inputs(T, buckets).alias("n"), stored.alias("o")
    same = F.col("n.product_id").eqNullSafe(F.col("o.product_id")) & F.col("n.order_state").eqNullSafe(F.col("o.order_state"))
    new, gone = F.col("o.line_id").isNull(), F.col("n.line_id").isNull()
    return now.join(old, F.col("n.line_id") == F.col("o.line_id"), "full").where(new | gone | ~same).select(
        F.coalesce("n.line_id", "o.line_id").alias("line_id"), "n.product_id", "n.order_state",
        F.coalesce("n.bucket", "o.bucket").alias("bucket"), gone.alias("gone"))


def refresh(T: Tables, path: str, company: str | int, buckets: int = BUCKETS) -> list[int]:
    """Bring the store up to date; returns the buckets that were rewritten."""
    spark = T["sale_order_line"].sparkSession
    if not current(spark, path).number:
        build(T, path, company, buckets)
        return list(range(buckets))
    changed = stage(changes(T, read_committed(spark, path), buckets), "changed-lines")
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # at most one row a bucket
    if touched:
        names = [f"bucket={b}" for b in touched]
        kept = read_committed(spark, path, names).join(changed, "line_id", "left_anti")
        fresh = _costed(changed.where(~F.col("gone")).drop("gone"), T["product_product"], company)
        commit(kept.unionByName(fresh).repartition(len(touched), "bucket"), path, ["bucket"], "partitions", replacing=names)
    return touched


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_committed(spark, path).drop("bucket")
