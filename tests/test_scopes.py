"""Windows and filters on order to cash: the same rows as filtering the finished report, by way of the keys."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filters as flt
from ledgerloom.operators.filters import Filters
from ledgerloom.plans import exports
from ledgerloom.plans import order_to_cash as o2c
from ledgerloom.plans.search import filtered_report, window_of
from ledgerloom.sources.fixtures import materialize
from ledgerloom.sources.tables import load_tables
from tests.conftest import SF0001

LO, HI = "1998-01-01", "1998-06-30"


@pytest.fixture(scope="module")
def S(spark):
    """Stored tables of sf0.001."""
    path = tempfile.mkdtemp(prefix="ll-scope-")
    materialize(spark, SF0001, path)
    return load_tables(spark, path)


@pytest.fixture(scope="module")
def full(S):
    return o2c.order_to_cash(S, keep_keys=True).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def read_tables(df):
    """Names of the stored tables that a plan reads."""
    return {f.split("/")[-2] for f in df.inputFiles()}


@pytest.mark.parametrize("lo,hi", [(LO, HI), ("1998-06-15", "1998-06-15"), (None, "1995-03-01"), ("2001-07-01", None), ("2030-01-01", None)])
def test_a_window_keeps_the_reports_rows(S, full, lo, hi):
    got = o2c.order_to_cash(S, lo, hi, keep_keys=True)
    assert rows(got) == rows(flt.date_range(full, "po_date", lo, hi))


@pytest.mark.parametrize("search,status", [
    ((("so_number", "77"),), ()), ((("po_date", "1998-06-15"),), ()), ((("customer", "0001"),), ("invoiced",)),
    ((("salesperson", "2"), ("company_name", "9")), ()), ((("delivery_number", "11"),), ()), ((("invoice_number", "31"),), ()),
    ((("delivery_number", "1"), ("invoice_number", "2"), ("so_number", "3")), ("standard", "paid")),
    ((("invoice_number", ""),), ()), ((("product_code", "p1"),), ()), ((("so_number", "no such"),), ()), ((), ("bundle", "not_paid"))])
def test_filters_keep_the_reports_rows(S, full, search, status):
    some = Filters(search, status)
    assert rows(filtered_report(S, "o2c", some, keep_keys=True)) == rows(some.apply(full))


def test_filters_with_a_window_and_few_columns(S, full):
    some = Filters((("customer", "00"), ("invoice_number", "/")), ("standard",))
    got = filtered_report(S, "o2c", some, LO, HI, columns=["so_number", "subtotal"])
    assert rows(got) == rows(some.apply(flt.date_range(full, "po_date", LO, HI)).select("so_number", "subtotal"))
    plain = o2c.order_to_cash(S, LO, HI, with_invoices=False, columns=["so_number", "delivered_qty"])
    assert plain.count() == flt.date_range(full, "po_date", LO, HI).select("line_id", "picking_id", "move_product_id", "bundle_line_id").distinct().count()


@pytest.mark.parametrize("build", [lambda T: exports.order_to_cash_export(T, LO, HI), lambda T: o2c.order_to_cash(T, "1998-06-15", "1998-06-15"),
                                   lambda T: filtered_report(T, "o2c", Filters((("po_date", "1998-06-15"),))),
                                   lambda T: filtered_report(T, "o2c", Filters((("so_number", "77"),)))])
def test_a_scoped_plan_starts_from_its_keys(S, build):
    df = build(S)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [move_id#" not in plan  # move lines are summed after they have met the scope's moves
    whole = read_tables(df)
    # lines, moves, junction rows and reconciliations have become keys already
    assert not whole & {"sale_order", "sale_order_line", "stock_move", "sale_order_line_invoice_rel", "account_partial_reconcile"}
    assert {"stock_move_line", "account_move_line"} <= whole
    assert "Aggregate [move_id#" in o2c.order_to_cash(S)._jdf.queryExecution().optimizedPlan().toString()


def test_days_and_months_become_windows(S):
    assert [str(d) for d in window_of(Filters((("so_month", "1996-02-01"), ("so_date", "1996-02-20"))))] == ["1996-02-20"] * 2
    for report, field, value in (("gp", "so_month", "1998-06-01"), ("sc", "so_date", "1998-06-15"), ("sc", "so_month", "1998-06-02")):
        some = Filters(((field, value),))
        assert rows(filtered_report(S, report, some)) == rows(some.apply(filtered_report(S, report, Filters())))


def test_first_payment_of_some_invoices(S):
    some = o2c.line_invoices(S).where("invoice_id % 3 = 0").select("invoice_id").distinct()
    edges = o2c.payment_edges(S, some)
    want = o2c.first_payment(S).join(some, "invoice_id", "left_semi")
    assert rows(o2c.first_payment(S, edges=edges)) == rows(want) and want.count() > 0
    lines = S["sale_order_line"].where("id % 4 = 1").select(F.col("id").alias("line_id"))
    assert rows(o2c.line_invoices(S, lines)) == rows(o2c.line_invoices(S).join(lines.withColumnRenamed("line_id", "so_line_id"), "so_line_id", "left_semi"))
