"""Work that grows with the order lines: numbered once for all tables, and only keys cut for row ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import load_table_queries
from ledgerloom.operators import row_id
from ledgerloom.plans import order_to_cash as o2c
from ledgerloom.sources.fixtures import derive, numbered_lines, order_lines

LINE_TABLES = ("sale_order_line", "account_move_line", "sale_order_line_invoice_rel", "stock_move", "stock_move_line", "sale_order_line_bundle")
LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def _driver(spark, path):
    day = dt.datetime(1998, 6, 1)
    line = lambda o, p, n: (o, p, 1, n, 2.0, 10.5, 0.0, 0.1, "N", "O", day)
    rows = [line(1, 7, 1), line(1, 7, 1), line(1, 8, 2), line(6, 3, 1), line(None, 2, 1), line(None, 1, 1)]
    spark.createDataFrame(rows, LINEITEM).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, 1, "O", day) for o in (1, 6)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "red", "Brand#1", 5.0)], "p_partkey long, p_name string, p_brand string, p_retailprice double").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, "c", "m")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")


def test_lines_are_numbered_once_for_all_tables(spark, tmp_path):
    _driver(spark, tmp_path)
    T = derive(spark, str(tmp_path))
    more = T | {"sale_order": T["sale_order"].where("id = 1")}
    assert not any(isinstance(x.data[t], DataFrame) for x in (T, more) for t in LINE_TABLES)  # nothing is staged unasked
    for t in LINE_TABLES:
        assert "Window" not in T[t]._jdf.queryExecution().optimizedPlan().toString(), t
    files = {t: {f.rsplit("/", 1)[0] for f in x[t].inputFiles() if "order-lines" in f} for x in (T, more) for t in LINE_TABLES}
    assert len(set.union(*files.values())) == 1 and all(files.values())
    got = sorted(map(str, T["sale_order_line"].select("id", "order_id", "product_id", "price_total").collect()))
    plain = order_lines(numbered_lines(spark.read.parquet(f"{tmp_path}/lineitem.parquet")))
    assert got == sorted(map(str, plain.select("id", "order_id", "product_id", "price_total").collect())) and len(got) == 6
    assert sorted(r.id for r in T["sale_order_line"].where("id is not null").collect()) == [1001, 1002, 1003, 6001]
    assert T["sale_order_line"].where("id is null").count() == 2


def test_row_ids_cut_only_the_keys(spark, T1, monkeypatch):
    seen, cut = [], row_id.reliable_cut
    monkeypatch.setattr(row_id, "reliable_cut", lambda df: cut(seen.append(df.columns) or df))
    got = load_table_queries()["row_id"](T1)
    keys = ["line_id", "picking_id", "move_product_id", "bundle_line_id", "invoice_id"]
    assert [set(c) - {"_mono"} for c in seen] == [set(keys)] and got.columns == ["id", *keys]
    n = o2c.order_to_cash(T1).count()
    assert got.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (1, n, n)


def test_one_shuffle_serves_delivered_sums_and_pickings(T1):
    plan = o2c.deliveries(T1, check_lines=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(so_line_id" not in plan and "Exchange hashpartitioning(picking_id" in plan
