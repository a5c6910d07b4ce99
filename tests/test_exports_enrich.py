"""Export tables, enrichments, sinks and plan checks."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import enrich, exports, order_to_cash
from ledgerloom.sources import sinks
from ledgerloom.sources.tables import load_tables

from test_reports import TS  # noqa: F401  (shared fixtures)
from test_reports import o2c_case, sales_case  # noqa: F401


def test_gross_profit_mtd_and_totals(tiny, sales_case):  # noqa: F811
    case = dict(sales_case)
    case["sale_order"] = [dict(id=1, name="S1", state="sale", date_order=TS(1998, 6, 2)),
                          dict(id=3, name="S3", state="done", date_order=TS(1998, 6, 20))]
    T = tiny(**case)
    mtd = {r["category_items"]: r for r in exports.gross_profit_mtd(T, "1998-06-15").collect()}
    # categories named alike merge by name; the empty 'Uncategorized' rows and
    # the order after as-of do not count
    assert mtd["A"]["amount"] == 150.0 and mtd["A"]["qty"] == 3.0
    assert mtd["A"]["total_gross_profit"] == pytest.approx(100 * 0.8 + 50 * (200 - 7) / 200)
    assert mtd["A"]["gp_percent"] == pytest.approx(round(mtd["A"]["total_gross_profit"] / 150, 6))
    assert mtd["Uncategorized"]["amount"] == 30.0
    tot = exports.gross_profit_total(T, "1998-06-15").first()
    assert tot["amount"] == 180.0
    rr = exports.sales_run_rate(T, "1998-06-15").first()
    assert (rr["day_of_month"], rr["days_in_month"]) == (15, 30)
    assert rr["daily_avg"] == pytest.approx(12.0) and rr["sales_estimate"] == pytest.approx(360.0)


def test_export_params_validation():
    with pytest.raises(ValueError):
        exports.ExportParams(report_type="all", as_of_date=None).validate()
    with pytest.raises(ValueError):
        exports.ExportParams(report_type="order_to_cash", date_from=dt.date(1998, 1, 1)).validate()
    p = exports.ExportParams.with_defaults("all", today=dt.date(1998, 6, 15))
    p.validate()
    assert p.as_of_date == p.date_from == p.date_to == dt.date(1998, 6, 15)


def test_export_all_and_o2c_labels(tiny, o2c_case):  # noqa: F811
    T = tiny(**o2c_case)
    out = exports.export_all(T, exports.ExportParams("all", dt.date(1998, 6, 15),
                                                     dt.date(1998, 6, 1), dt.date(1998, 6, 30)))
    assert set(out) == {"gross_profit", "gross_profit_total", "gross_profit_run_rate", "order_to_cash",
                        "sales_contribution", "sales_contribution_total"}
    rows = out["order_to_cash"].collect()
    assert len(out["order_to_cash"].columns) == 32
    assert {r["delivery_status"] for r in rows} == {"DONE"}
    assert {r["invoice_status"] for r in rows} == {"Invoiced"}
    assert {r["payment_state"] for r in rows} == {"Posted", "Not Paid"}
    sc_total = out["sales_contribution_total"].first()
    assert sc_total["sales_contribution_percent"] == 1.0 and sc_total["sales_amount"] == 100.0


def test_cost_snapshot_and_refresh(spark):
    lines = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, 12)], "id long, product_id long")
    prods = spark.createDataFrame([(10, '{"1": 5.5, "2": 7}'), (11, None), (12, '{"1": 3}')],
                                  "id long, standard_price string")
    got = {r["line_id"]: r["purchase_price"] for r in enrich.cost_snapshot(lines, prods, 2).collect()}
    assert got == {1: 7.0, 2: 0.0, 3: 0.0, 4: 0.0}
    snap = enrich.cost_snapshot(lines, prods, 1)
    prods2 = spark.createDataFrame([(10, '{"1": 9}'), (11, None), (12, '{"1": 3}')],
                                   "id long, standard_price string")
    changed = spark.createDataFrame([(1,)], "line_id long")
    fresh = {r["line_id"]: r["purchase_price"]
             for r in enrich.refresh_cost_snapshot(snap, lines, prods2, 1, changed).collect()}
    assert fresh == {1: 9.0, 2: 0.0, 3: 0.0, 4: 3.0}


def test_bundle_display_and_component_label(spark):
    lines = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    comps = spark.createDataFrame(
        [(12, 1, 11, 12345678.0, None), (11, 1, 10, 2.0, 1), (21, 2, 99, 1.0, 1), (31, 3, None, None, None)],
        "id long, line_id long, product_id long, quantity double, uom_id long")
    prods = spark.createDataFrame([(10, 10, "P10"), (11, 11, " ")], "id long, product_tmpl_id long, default_code string")
    tmpls = spark.createDataFrame([(10, '{"en_US": "Chair"}'), (11, "Desk")], "id long, name string")
    uoms = spark.createDataFrame([(1, "Unit")], "id long, name string")
    bd = {r["line_id"]: r["bundle_display"]
          for r in enrich.bundle_display(lines, comps, prods, tmpls).collect()}
    # ordered by component id; ' ' is a code (truthy); missing product skipped; no product -> ''
    assert bd == {1: "[P10] Chair, [ ] Desk", 2: "", 3: ""}
    cl = {r["id"]: r["display_name"] for r in enrich.component_label(comps, prods, tmpls, uoms).collect()}
    assert cl[11] == "[P10] Chair x2.0 Unit"
    assert cl[12] == "[ ] Desk x12345678.0 "
    assert cl[21] == "Sale Order Line Bundle, 21"
    assert cl[31] == "Sale Order Line Bundle, 31"


def test_sink_roundtrip_and_order(spark, tiny, o2c_case):  # noqa: F811
    T = tiny(**o2c_case)
    rep = order_to_cash.order_to_cash(T, keep_keys=True)
    ordered = sinks.ordered_for_sink(rep, order_to_cash.report_order(), order_to_cash.HIDDEN_KEYS)
    path = os.path.join(tempfile.mkdtemp(prefix="ll-sink-"), "o2c")
    sinks.write_report(ordered, path, "parquet", partition_by=["po_date"])
    back = sinks.read_report(spark, path).select(*order_to_cash.COLUMNS)
    assert sorted(map(str, back.collect())) == sorted(map(str, rep.select(*order_to_cash.COLUMNS).collect()))
    csv = os.path.join(os.path.dirname(path), "csv")
    sinks.write_report(rep.select("so_number", "subtotal"), csv, "csv")
    assert sinks.read_report(spark, csv, "csv").count() == rep.count()


def test_pushdown_and_pruning_on_stored_tables(spark, T1):
    base = tempfile.mkdtemp(prefix="ll-stored-")
    for name in ("sale_order", "sale_order_line"):
        T1[name].write.parquet(os.path.join(base, name))
    S = load_tables(spark, base, tables=("sale_order", "sale_order_line"))
    assert "x_studio_date" in S["sale_order"].columns
    from ledgerloom.plans.common import valid_orders
    df = valid_orders(S).join(S["sale_order_line"].select("order_id", "price_subtotal"), "order_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(state), In(state, [done,sale])" in plan or \
        "In(state, [done,sale])" in plan
    # only the needed columns are read from the line table
    assert "ReadSchema: struct<order_id:bigint,price_subtotal:decimal(18,2)>" in plan


def test_conform_checks_required_and_keeps_optional(spark, T1):
    from ledgerloom.sources.tables import conform
    so = T1["sale_order"]
    assert "x_studio_date" in conform(so, "sale_order").columns
    assert "x_studio_date" not in conform(so.drop("x_studio_date"), "sale_order").columns
    with pytest.raises(ValueError):
        conform(so.drop("state"), "sale_order")
    # every derived table already matches its declared schema
    for name, df in T1.items():
        assert conform(df, name).schema == df.select(*conform(df, name).columns).schema, name


def test_order_window_reaches_the_scan(spark, T1):
    base = tempfile.mkdtemp(prefix="ll-window-")
    T1["sale_order"].write.parquet(os.path.join(base, "sale_order"))
    S = load_tables(spark, base, tables=("sale_order",))
    from ledgerloom.plans.common import valid_orders
    win = valid_orders(S, "1998-06-01", "1998-06-15")
    plan = win._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "x_studio_date" in pushed and "date_order" in pushed
    # the pushable form selects exactly the same orders as the effective-date filter
    full = valid_orders(S).where(F.col("order_date").between(dt.date(1998, 6, 1), dt.date(1998, 6, 15)))
    assert sorted(map(tuple, win.collect())) == sorted(map(tuple, full.collect()))
    plain = valid_orders(S, "1998-06-01", "1998-06-15", custom_date=False, date_col="d")
    plain_full = valid_orders(S, custom_date=False, date_col="d").where(
        F.col("d").between(dt.date(1998, 6, 1), dt.date(1998, 6, 15)))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, plain_full.collect()))


def test_command_line_export_and_report(spark, capsys):
    from ledgerloom.__main__ import main
    from conftest import SF0001
    out = tempfile.mkdtemp(prefix="ll-cli-")
    main(["export", "--driver-sf", SF0001, "--report", "all", "--as-of", "1998-06-15",
          "--date-from", "1998-06-01", "--date-to", "1998-06-30", "--out", f"{out}/exp"])
    assert spark.read.parquet(f"{out}/exp/gross_profit_total").count() == 1
    assert len(spark.read.parquet(f"{out}/exp/order_to_cash").columns) == 32
    main(["report", "sales_contribution", "--driver-sf", SF0001, "--out", f"{out}/sc", "--format", "csv"])
    assert spark.read.option("header", True).csv(f"{out}/sc").count() > 0
    assert not spark.sparkContext._jsc.sc().isStopped()


def test_catalog_tables(spark, T1):
    from ledgerloom.sources.tables import load_catalog_tables
    T1["sale_order"].createOrReplaceTempView("sale_order")
    S = load_catalog_tables(spark, tables=("sale_order",))
    assert S["sale_order"].count() == T1["sale_order"].count()


def test_bucketed_tables_join_without_shuffle(spark, T1):
    from ledgerloom.plans.common import valid_orders
    from ledgerloom.sources.tables import load_catalog_tables, store_tables
    names = ("sale_order", "sale_order_line", "account_move", "account_move_line")
    store_tables({n: T1[n] for n in names}, "erp_bucketed", buckets=4)
    S = load_catalog_tables(spark, "erp_bucketed", tables=names)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = S["sale_order_line"].select("order_id", "price_subtotal").join(valid_orders(S), "order_id")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        aml = S["account_move_line"].join(S["account_move"].withColumnRenamed("id", "move_id"), "move_id")
        assert "Exchange" not in aml._jdf.queryExecution().executedPlan().toString()
        assert df.count() == T1["sale_order_line"].join(valid_orders(T1), "order_id").count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_duplicate_json_keys_rejected(spark, T1):
    from ledgerloom.sources.tables import reject_duplicate_json_keys
    reject_duplicate_json_keys(T1)  # the derived tables are clean
    bad = spark.createDataFrame([(1, 1, "P1", '{"2": 1, "2": 3}'), (2, 2, None, "plain")],
                                "id long, product_tmpl_id long, default_code string, standard_price string")
    with pytest.raises(ValueError, match="repeat a key"):
        reject_duplicate_json_keys({"product_product": bad})
