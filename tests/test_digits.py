"""Stored digits survive loading and the reports; unknown costs stay unknown."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.plans import contribution, exports, gross_profit, order_to_cash
from ledgerloom.sources.tables import SCHEMAS, conform, load_tables

DAY = dt.date(1998, 6, 10)


def line(**kw):
    return dict(id=1, order_id=1, product_id=1, sequence=1, product_uom_qty=Decimal("2"), price_unit=Decimal("5"),
                price_subtotal=Decimal("10"), price_tax=Decimal("0"), price_total=Decimal("10"), purchase_price=0.0) | kw


def base(tiny, **kw):
    rows = dict(
        product_category=[dict(id=1, name="C")], product_template=[dict(id=1, name="T", categ_id=1)],
        product_product=[dict(id=1, product_tmpl_id=1, standard_price='{"1": 3.0}')],
        sale_order=[dict(id=1, name="S1", state="sale", date_order=dt.datetime(1998, 7, 10))], sale_order_line=[line()],
        account_move=[dict(id=1, name="I1", move_type="out_invoice", state="posted", invoice_date=DAY)],
        account_move_line=[dict(id=1, move_id=1, account_id=1, quantity=None, price_subtotal=Decimal("10"))],
        sale_order_line_invoice_rel=[dict(order_line_id=1, invoice_line_id=1)])
    return tiny(**(rows | kw))


def test_stored_numbers_load_unchanged(spark):
    path = tempfile.mkdtemp(prefix="ll-digits-")
    stored = spark.createDataFrame([(1, 1, Decimal("0.1250"), Decimal("0.0049"), 7)],
                                   "id long, move_id long, quantity decimal(20,4), price_subtotal decimal(30,4), account_id long")
    stored.write.parquet(f"{path}/account_move_line")
    back = load_tables(spark, path, tables=("account_move_line",))["account_move_line"].first()
    assert (back["quantity"], back["price_subtotal"]) == (Decimal("0.1250"), Decimal("0.0049"))
    floats = conform(spark.createDataFrame([(1, 1, 1, 0.125, 3)], "id long, move_id long, account_id long, quantity double, price_subtotal int"),
                     "account_move_line").first()
    assert (floats["quantity"], floats["price_subtotal"]) == (Decimal("0.125"), Decimal(3))
    assert "quantity" in SCHEMAS["account_move_line"]


def test_unknown_quantities_leave_the_ratio_unknown(tiny):
    T = base(tiny)
    assert gross_profit.monthly_margin(T).first()["gp_percent_accounting"] is None
    rep = gross_profit.gross_profit(T).where("categ_id = 1").first()
    assert (rep["amount"], rep["gp_percent"], rep["total_gross_profit"]) == (10.0, 0.0, 0.0)
    mtd = exports.gross_profit_mtd(T, "1998-07-31").first()
    assert (mtd["amount"], mtd["total_gross_profit"], mtd["gp_percent"]) == (10.0, 0.0, 0.0)


def test_costs_keep_all_digits(tiny):
    T = base(tiny, sale_order_line=[line(product_uom_qty=Decimal("0.33"), purchase_price=3.12345678)])
    assert contribution.sales_contribution(T).first()["cogs"] == pytest.approx(0.33 * 3.12345678, abs=1e-15)
    T = base(tiny, sale_order_line=[line(purchase_price=2e12)])
    assert contribution.sales_contribution(T).first()["cogs"] == 4e12


def test_mtd_equals_the_grid_summed(T2):
    first, last = "1998-06-01", "1998-06-15"
    grid = (gross_profit.gross_profit(T2, first, last).groupBy("category_items")
            .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.sum("total_gross_profit").alias("gp"))
            .where("not (qty = 0 and amount = 0)").collect())
    mtd = {r["category_items"]: r for r in exports.gross_profit_mtd(T2, last).collect()}
    assert set(mtd) == {r["category_items"] for r in grid}
    for r in grid:
        m = mtd[r["category_items"]]
        assert (m["qty"], m["amount"]) == (pytest.approx(r["qty"]), pytest.approx(r["amount"]))
        assert m["total_gross_profit"] == pytest.approx(r["gp"], abs=1e-6)
    plan = exports.gross_profit_mtd(T2, last)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("x", [0.0, -0.0, 1e-11, 1e-05, 0.0001, 0.00012345, 1e15, 1e16, 1.5e300, -2.5e-7, 123456789.125, 0.1, 2.0, 1e22,
                               float("inf"), float("-inf"), float("nan")])
def test_python_float_text(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(text.py_float_text("x")).first()[0] == "%s" % x


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_footer_reads_no_lookup_tables(spark, T1):
    footed = order_to_cash.order_to_cash(T1, columns=["subtotal", "tax_amount", "total_amount"]).agg(F.sum("subtotal"))
    full = order_to_cash.order_to_cash(T1)
    assert optimized(footed).count("Join LeftOuter") <= 2 < optimized(full).count("Join LeftOuter")
    rows = order_to_cash.order_to_cash(T1, columns=["so_number", "subtotal"])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, full.select("so_number", "subtotal").collect()))


def test_window_adds_no_lookup(T1):
    full, window = (optimized(df) for df in (order_to_cash.order_to_cash(T1), exports.order_to_cash_export(T1, "1998-01-01", "1998-06-30")))
    assert window.count("Join LeftOuter") <= full.count("Join LeftOuter")
