"""Golden aggregates at sf0.01 (FIXTURES.md section 4) and invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import contribution, exports, gross_profit, order_to_cash


def agg(df, **exprs):
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict()


def test_fixture_counts(T2):
    want = {"product_category": 25, "product_template": 2000, "product_product": 2000, "sale_order": 15000,
            "sale_order_line": 60000, "account_move": 18750, "account_move_line": 73540,
            "sale_order_line_invoice_rel": 58990, "account_partial_reconcile": 6524, "account_payment": 5000,
            "stock_picking": 18000, "stock_move": 85718, "stock_move_line": 114264, "res_partner": 1600,
            "res_users": 100}
    from ledgerloom.sources.tables import table_counts
    got = {r["table_name"]: r["row_count"] for r in table_counts({k: T2[k] for k in want}).collect()}
    assert got == want


def test_gross_profit_golden(T2):
    rep = gross_profit.gross_profit(T2)
    a = agg(rep, n=F.count(F.lit(1)), qty=F.sum("qty"), amount=F.sum(F.col("amount").cast("decimal(38,2)")),
            gp=F.sum("total_gross_profit"), cur=F.sum("gp_percent_current_month"),
            names=F.countDistinct("category_items"),
            prev=F.sum(F.when(F.col("gp_percent") != 0, 1).otherwise(0)))
    assert a["n"] == 61490 and a["names"] == 24 and a["prev"] == 58350
    assert a["qty"] == pytest.approx(935964)
    assert float(a["amount"]) == pytest.approx(1957257915.61, abs=0.005)
    assert a["gp"] == pytest.approx(990833146.54, abs=0.05)
    # each ratio is rounded to 6 places; ~2,080 ratios repeat over ~30 days each
    assert a["cur"] == pytest.approx(29468.269302, abs=1e-3)


def test_spine_invariant(T2):
    cats = gross_profit.category_dim(T2).count()
    dates = gross_profit.order_dates(T2).count()
    assert gross_profit.gross_profit(T2).count() == cats * dates


def test_first_payment_golden(T2):
    a = agg(order_to_cash.first_payment(T2), n=F.count(F.lit(1)), lo=F.min("first_payment_date"),
            hi=F.max("first_payment_date"))
    assert (a["n"], str(a["lo"]), str(a["hi"])) == (5358, "1995-02-06", "2001-09-04")


def test_order_to_cash_golden(T2):
    rep = order_to_cash.order_to_cash(T2, keep_keys=True)
    a = agg(rep, n=F.count(F.lit(1)), lines=F.countDistinct("line_id"),
            bundle=F.sum(F.when(F.col("line_type") == "Bundle", 1).otherwise(0)),
            inv=F.count("invoice_id"), paid=F.count("payment_date"), dq=F.sum("delivered_qty"))
    assert (a["n"], a["lines"], a["bundle"], a["inv"], a["paid"]) == (55829, 33634, 15197, 39122, 16781)
    assert a["dq"] == pytest.approx(109468)


def test_sales_contribution_golden(T2):
    rep = contribution.sales_contribution(T2)
    a = agg(rep, n=F.count(F.lit(1)), s=F.sum(F.col("sales_amount").cast("decimal(38,2)")),
            c=F.sum(F.col("cogs").cast("decimal(38,2)")), share=F.sum("sales_contribution_percent"),
            zero=F.sum(F.when(F.col("categ_id") == 0, 1).otherwise(0)),
            days=F.countDistinct("so_date"))
    assert a["n"] == 27670 and a["zero"] == 1366
    assert float(a["s"]) == pytest.approx(2098479740.29, abs=0.005)
    assert float(a["c"]) == pytest.approx(865151925.00, abs=0.005)
    assert a["share"] == pytest.approx(2362, abs=1e-3) and a["days"] == 2362


def test_month_to_date_export_golden(T2):
    mtd = exports.gross_profit_mtd(T2, "1998-06-15")
    a = agg(mtd, n=F.count(F.lit(1)), qty=F.sum("qty"))
    assert a["n"] == 24 and a["qty"] == pytest.approx(5320)
    t = exports.gross_profit_total(T2, "1998-06-15").first()
    assert t["amount"] == pytest.approx(11412483.36, abs=0.005)
    assert t["total_gross_profit"] == pytest.approx(5627874.78, abs=0.005)
    assert t["gp_percent"] == pytest.approx(0.493133, abs=1e-6)
    r = exports.sales_run_rate(T2, "1998-06-15").first()
    assert r["daily_avg"] == pytest.approx(760832.2240, abs=1e-3)
    assert r["sales_estimate"] == pytest.approx(22824966.72, abs=0.005)
    # F2 equals the sum of F1
    assert agg(mtd, s=F.sum("amount"))["s"] == pytest.approx(t["amount"])


def test_text_chain_golden(T2):
    """Sum of text lengths over the delivery-grain rows of valid orders."""
    rep = order_to_cash.order_to_cash(T2, with_invoices=False)
    want = {"product_name": 430235, "product_code": 195490, "bundle_name": 115595, "customer": 847422,
            "company_name": 930087, "receiver": 849026, "delivery_address": 1003017, "incoterm": 60435,
            "shipping_note": 397529, "branch_delivery": 200663}
    a = agg(rep, n=F.count(F.lit(1)),
            gaps=F.sum(F.when(F.col("delivery_address").contains(", , "), 1).otherwise(0)),
            **{k: F.sum(F.length(k)) for k in want})
    assert a.pop("n") == 48162 and a.pop("gaps") == 11973
    assert a == want


def test_order_to_cash_row_invariant(T2):
    """rows = sum over delivered lines of valid orders of deliveries x max(1, invoices)."""
    from ledgerloom.plans.common import valid_orders
    lines = (T2["sale_order_line"].join(valid_orders(T2), "order_id", "left_semi")
             .select(F.col("id").alias("so_line_id")))
    d = order_to_cash.deliveries(T2).groupBy("so_line_id").agg(F.count(F.lit(1)).alias("d"))
    i = order_to_cash.line_invoices(T2).groupBy("so_line_id").agg(F.count(F.lit(1)).alias("i"))
    want = (lines.join(d, "so_line_id").join(i, "so_line_id", "left")
            .agg(F.sum(F.col("d") * F.greatest(F.lit(1), F.coalesce("i", F.lit(0))))).first()[0])
    assert order_to_cash.order_to_cash(T2).count() == want == 55829
