"""Skew: one order holding a third of all lines must give the same report rows
whether AQE splits the skewed join partitions or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import contribution, gross_profit, order_to_cash

FORCE_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}
NO_AQE = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def _run(spark, conf, build):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return sorted(map(str, build().collect()))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_order_same_results(spark, T1):
    hot = T1["sale_order"].where(F.col("state") == "sale").agg(F.min("id")).first()[0]
    T = dict(T1)
    T["sale_order_line"] = T1["sale_order_line"].withColumn(
        "order_id", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("order_id")))
    for build in (lambda: contribution.sales_contribution(T),
                  lambda: gross_profit.daily_category_sales(T),
                  lambda: order_to_cash.order_to_cash(T)):
        assert _run(spark, FORCE_SKEW, build) == _run(spark, NO_AQE, build)


def test_hot_receivable_line_same_results(spark, T1):
    """One invoice's receivable line reconciled against a third of all payments."""
    hot = T1["account_partial_reconcile"].agg(F.min("debit_move_id")).first()[0]
    T = dict(T1)
    rec = T1["account_partial_reconcile"]
    T["account_partial_reconcile"] = rec.withColumn(
        "debit_move_id", F.when(F.abs(F.col("credit_move_id")) % 3 == 0, F.lit(hot))
        .otherwise(F.col("debit_move_id")))
    build = lambda: order_to_cash.first_payment(T, states=("draft", "posted"))
    assert _run(spark, FORCE_SKEW, build) == _run(spark, NO_AQE, build)
