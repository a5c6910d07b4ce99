"""Reusable DataFrame operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import filters, grouping
from ledgerloom.operators.joins import symmetric_edges
from ledgerloom.operators.records import read_records
from ledgerloom.operators.row_id import dense_row_id


def test_dense_row_id_equals_row_number(spark):
    df = spark.range(0, 1000, numPartitions=4).select(
        (F.col("id") % 37).alias("a"), (F.col("id") * 7919 % 1000).alias("b"))
    order = [F.col("a").desc(), F.col("b").asc()]
    got = dense_row_id(df, order, num_partitions=4).select("a", "b", "id")
    want = df.select("a", "b", F.row_number().over(Window.orderBy(*order)).alias("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_row_id_numbers_in_parallel(spark):
    df = spark.range(0, 1000, numPartitions=4).select((F.col("id") % 7).alias("a"), "id")
    got = dense_row_id(df, [F.col("a"), F.col("id")], num_partitions=4)
    # rows stay spread over the range partitions; nothing is gathered into one task
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (1, 1000, 1000)


def test_symmetric_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "d long, c long")
    got = sorted(map(tuple, symmetric_edges(pairs, "d", "c").collect()))
    assert got == [(1, 2), (2, 1)]


def test_date_range_and_presets(spark):
    rows = [(dt.date(1998, 6, d),) for d in range(1, 31)] + [(dt.date(1998, 5, 31),), (None,)]
    df = spark.createDataFrame(rows, "d date")
    assert filters.date_range(df, "d", "1998-06-10", "1998-06-12").count() == 3
    assert filters.date_range(df, "d", None, "1998-06-02").count() == 3


def test_status_presets_and_search(spark):
    df = spark.createDataFrame(
        [("", "done", "invoiced", "Bundle", "Red Chair"), ("posted", "done", "to invoice", "Standard", "desk")],
        "payment_state string, delivery_status string, invoice_status string, line_type string, "
        "product_name string")
    assert filters.status_preset(df, "paid").count() == 1
    assert filters.status_preset(df, "not_paid").count() == 1
    assert filters.status_preset(df, "not_delivered").count() == 0
    assert filters.status_preset(df, "invoiced").count() == 1
    assert filters.status_preset(df, "bundle").count() == 1
    assert filters.search(df, "product_name", "RED").count() == 1


def test_grouping_helpers(spark):
    df = spark.createDataFrame([("a", dt.date(1998, 6, 3), 1.5), ("a", dt.date(1998, 7, 3), 2.25),
                                ("b", dt.date(1998, 6, 9), 4.0)], "k string, d date, m double")
    g = {r["k"]: (r["m"], r["row_count"]) for r in grouping.group_report(df, "k", ["m"]).collect()}
    assert g == {"a": (3.75, 2), "b": (4.0, 1)}
    months = grouping.group_report(df, "d", ["m"], grain="month").collect()
    assert sorted((r["d_month"], r["m"]) for r in months) == [(dt.date(1998, 6, 1), 5.5),
                                                              (dt.date(1998, 7, 1), 2.25)]
    f = grouping.footer(df, ["m"]).first()
    assert (f["m"], f["row_count"]) == (7.75, 3)
    cube = grouping.pivot_long(df, F.col("k"), grouping.group_key("d", "month"), ["m"]).collect()
    total = [r for r in cube if r["grouping_level"] == 3]
    assert len(total) == 1 and total[0]["m"] == 7.75


def test_read_records_keeps_order_and_missing_ids(spark):
    rep = spark.createDataFrame([(1, "x", 10), (2, "y", None), (3, "z", 0)], "id long, name string, ref long")
    dim = spark.createDataFrame([(10, "Ten")], "id long, name string")
    ids = spark.createDataFrame([(0, 2), (1, 9), (2, 1)], "pos long, id long")
    got = read_records(rep, ids, ["name", "ref"], {"ref": (dim, "name")}).collect()
    assert [r["id"] for r in got] == [2, 9, 1]
    assert got[0]["ref"] is None and got[1]["name"] is None
    assert got[2]["ref"]["id"] == 10 and got[2]["ref"]["display_name"] == "Ten"
    # key 0 is an empty reference, as NULL is
    zero = read_records(rep, spark.createDataFrame([(0, 3)], "pos long, id long"), ["ref"], {"ref": (dim, "name")}).first()
    assert zero["id"] == 3 and zero["ref"] is None


