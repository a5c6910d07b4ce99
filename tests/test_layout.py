"""The whole order-to-cash report is laid out by order: texts come to an order once, rows stay those of plain joins."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.filters import Filters
from ledgerloom.plans import order_to_cash as o2c
from ledgerloom.plans.search import filtered_report
from ledgerloom.sources.fixtures import LINE_ORDER, numbered_lines
from tests.conftest import SF0001

KEYS = ["order_id", "line_id", "picking_id", "move_product_id", "bundle_line_id", "invoice_id", "so_number", "customer", "salesperson",
        "qty", "delivered_qty", "delivery_number", "payment_date"]


@pytest.fixture(scope="module")
def odd(spark, T1):
    """Tables with rows that come twice and with missing keys."""
    T = {**T1, "sale_order_line": T1["sale_order_line"], "stock_move": T1["stock_move"], "account_move_line": T1["account_move_line"],
         "sale_order_line_invoice_rel": T1["sale_order_line_invoice_rel"], "stock_move_line": T1["stock_move_line"]}
    for name in ("sale_order", "sale_order_line", "stock_picking", "product_product", "res_partner", "account_move", "stock_move", "res_users"):
        T[name] = T[name].unionByName(T[name].where("id % 5 = 1"))
    # one line id in two orders; no picking, no product, no partner
    lines = T["sale_order_line"]
    T["sale_order_line"] = lines.unionByName(lines.where("id % 7 = 3").withColumn("order_id", F.col("order_id") + 1)).withColumn(
        "product_id", F.when(F.col("id") % 11 != 4, F.col("product_id")))
    moves = T["stock_move"]
    T["stock_move"] = moves.withColumn("picking_id", F.when(F.col("id") % 13 != 5, F.col("picking_id"))).withColumn(
        "product_id", F.when(F.col("id") % 17 != 5, F.col("product_id")))
    T["sale_order"] = T["sale_order"].withColumn("partner_id", F.when(F.col("id") % 6 != 1, F.col("partner_id")))
    return T


def plain(T):
    x = (o2c.order_lines_named(T).join(o2c.order_header(T), "order_id")
         .join(o2c.deliveries(T, check_lines=False, with_receiver=True).withColumnRenamed("so_line_id", "line_id"), "line_id"))
    pay = o2c.first_payment(T).withColumnRenamed("invoice_id", "paid_id")
    inv = o2c.line_invoices(T).withColumnRenamed("so_line_id", "line_id").join(pay, F.col("invoice_id") == F.col("paid_id"), "left")
    x = x.join(inv, "line_id", "left")
    return x.withColumns({"qty": F.col("product_uom_qty").cast("double"), "delivered_qty": F.col("total_delivered_qty").cast("double"),
                          "payment_date": F.col("first_payment_date")}).select(*KEYS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_rows_are_those_of_plain_joins(odd):
    got = o2c.order_to_cash(odd, keep_keys=True).select(*KEYS)
    assert rows(got) == rows(plain(odd)) and got.count() > 5000


@pytest.mark.parametrize("some", [Filters((("delivery_number", "1"),)), Filters((("invoice_number", "2"),)), Filters((), ("bundle",)),
                                  Filters((("shipping_note", ""), ("company_name", "0")), ("standard", "invoiced")), Filters((), ("paid",))])
def test_filters_that_many_rows_pass_follow_no_keys(odd, T1, some):
    odd = {**odd, "account_move": T1["account_move"]}
    got = filtered_report(odd, "o2c", some, keep_keys=True)
    assert not [f for f in got.inputFiles() if "stage-line-ids" in f or "stage-junction" in f]
    assert rows(got) == rows(some.apply(o2c.order_to_cash(odd, keep_keys=True)))


def test_nothing_wide_is_laid_out_by_line(spark, T1):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = o2c.order_to_cash(T1)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(line_id" not in plan and "hashpartitioning(order_id" in plan
    assert not re.search(r"hashpartitioning\(order_id#\d+L, \w+#", plan)  # joins on a second key keep the layout


def test_line_numbers_ship_no_more_than_they_need(spark):
    raw = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    assert {"l_returnflag", "l_linestatus", "l_shipdate"}.isdisjoint(LINE_ORDER)
    twice = raw.unionByName(raw.withColumn("l_returnflag", F.lit("x"))).limit(500)
    got = numbered_lines(twice)
    assert got.count() == 500 and got.select("l_orderkey", "place").distinct().count() == 500


def test_an_export_drops_its_own_stages_only(spark, tmp_path):
    from ledgerloom.__main__ import main
    from ledgerloom.sources.staging import stage, staged_so_far
    mine = stage(spark.range(3).toDF("k"), "mine")
    before = staged_so_far()
    main(["report", "sales_contribution", "--driver-sf", SF0001, "--out", str(tmp_path / "sc"), "--date-from", "1998-06-01", "--date-to", "1998-06-05"])
    assert staged_so_far() == before and mine.count() == 3


def test_order_lines_stay_where_they_are_stored(spark):
    from ledgerloom.sources.staging import drop_stages, stage_by, staged_so_far
    before = staged_so_far()
    mine = spark.createDataFrame([(i % 40 if i % 41 else None, i) for i in range(400)], "k long, v long")
    stored = stage_by(mine, "test", "k")
    assert sorted(map(str, stored.collect())) == sorted(map(str, mine.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = stored.join(spark.range(20).withColumnRenamed("id", "k").repartition("k"), "k")
        assert both.count() == mine.where("k < 20").count()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        drop_stages(spark, before)
    assert staged_so_far() == before


def test_sums_of_moves_come_to_orders_by_key(spark, T1):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = o2c.order_to_cash(T1)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_move = [i for i, row in enumerate(plan) if "Exchange hashpartitioning(move_id#" in row]
    read = [next(row for row in plan[i:] if "Scan" in row) for i in by_move]
    assert by_move and not [row for row in read if "picking_id" in row or "move_product_id" in row]


def test_stored_buckets_are_sorted(spark):
    from ledgerloom.sources.staging import drop_stages, stage_by, staged_so_far
    before = staged_so_far()
    mine = spark.createDataFrame([((i * 7919) % 997 if i % 41 else None, i) for i in range(2000)], "k long, v long")
    files = stage_by(mine.coalesce(2), "test", "k").inputFiles()
    got = [[r["k"] for r in spark.read.parquet(f).collect()] for f in files]
    assert sum(map(len, got)) == 2000 and all(ks == sorted(ks, key=lambda k: (k is not None, k)) for ks in got)
    drop_stages(spark, before)


def test_both_reports_share_the_shuffled_junction(spark, T1):
    from ledgerloom.plans.gross_profit import monthly_margin
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        both = o2c.order_to_cash(T1).agg(F.count("*").alias("n")).unionByName(monthly_margin(T1).agg(F.count("*").alias("n")))
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "ReusedExchange [order_line_id#" in plan
