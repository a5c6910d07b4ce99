"""Query registrations: one key per SURVEY section 2 operator, each a function
of the base tables (``catalog.query`` wraps it with the fixture derivation)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import AS_OF, DATE_FROM, DATE_TO, TODAY, query
from ..functions.dates import effective_order_date, preset_bounds
from ..functions.labels import delivery_status_label, invoice_status_label, payment_state_label
from ..functions.money import out, safe_ratio
from ..functions.text import first_nonblank, localized, strip_html
from ..operators import filters as flt
from ..operators import grouping as grp
from ..operators.records import read_records
from ..operators.row_id import dense_row_id
from ..sources import committed, numbered
from ..sources.sinks import read_report, shared_output_dir, write_report
from ..sources.tables import load_tables, table_counts
from . import contribution as sc
from . import cost_store
from . import enrich as en
from . import exports as ex
from . import gross_profit as gp
from . import order_to_cash as o2c
from . import state
from .common import product_names, valid_orders
from .search import REPORTS, filtered_report
from .views import register_reports


# ---- D: Sales Contribution -------------------------------------------------
@query("category_sales")
def _category_sales(T):
    """Per-category daily sums (exact decimals shown as doubles)."""
    cs = sc.category_sales(T)
    return cs.select("category", "categ_id", "so_date", "so_month",
                     out("sales").alias("sales_amount"), "cogs",
                     F.col("profit").alias("gross_profit"))


@query("daily_totals")
def _daily_totals(T):
    """Each category-day with its day's total sales (window over the aggregate)."""
    cs = sc.with_daily_totals(sc.category_sales(T))
    return cs.select("category", "categ_id", "so_date", out("day_total").alias("daily_total"))


@query("margin_ratio")
def _margin_ratio(T):
    """D3: guarded margin ratio per category-day."""
    cs = sc.category_sales(T)
    return cs.select("category", "categ_id", "so_date",
                     safe_ratio("profit", "sales").alias("margin_percent"))


@query("contribution_share")
def _contribution_share(T):
    """Guarded share of the day's sales per category-day."""
    cs = sc.with_daily_totals(sc.category_sales(T))
    return cs.select("category", "categ_id", "so_date",
                     safe_ratio("sales", "day_total").alias("sales_contribution_percent"))


@query("sales_contribution")
def _sales_contribution(T):
    """The report."""
    return sc.sales_contribution(T)


# ---- B: Gross Profit --------------------------------------------------------


@query("effective_date")
def _effective_date(T):
    """B1: custom order date when set, else the order date (all orders)."""
    so = T["sale_order"]
    return so.select(F.col("id").alias("order_id"), effective_order_date(so).alias("order_date"))


@query("valid_orders")
def _valid_orders(T):
    """B2: confirmed or done orders with their effective date."""
    return valid_orders(T)


@query("category_dim")
def _category_dim(T):
    """Category dimension plus the unkeyed 'Uncategorized' member."""
    return gp.category_dim(T)


@query("daily_category_sales")
def _daily_category_sales(T):
    """Daily qty/amount per category."""
    d = gp.daily_category_sales(T)
    return d.select("category_items", "categ_id", "so_date", "so_month",
                    out("qty").alias("qty"), out("amount").alias("amount"))


@query("monthly_margin")
def _monthly_margin(T):
    """Monthly invoiced margin ratio per category."""
    m = gp.monthly_margin(T)
    return m.select("category_items", "categ_id", "inv_month",
                    "gp_percent_accounting")


@query("order_dates")
def _order_dates(T):
    """Distinct valid order dates."""
    return gp.order_dates(T)


@query("category_date_spine")
def _category_date_spine(T):
    """Dense category x date grid."""
    return gp.category_date_spine(T)


@query("spine_fill")
def _spine_fill(T):
    """Grid filled with daily sales (0 when none)."""
    g = gp.spine_fill(gp.category_date_spine(T), gp.daily_category_sales(T).drop("so_month"))
    return g.select("category_items", "categ_id", "so_date", "so_month",
                    out("qty").alias("qty"), out("amount").alias("amount"))


@query("prev_month_margin")
def _prev_month_margin(T):
    """Previous calendar month's margin for every grid row."""
    g = gp.margin_lookup(gp.category_date_spine(T), gp.monthly_margin(T), 1, "gp_percent")
    return g.select("category_items", "categ_id", "so_date", "so_month",
                    "gp_percent")


@query("curr_month_margin")
def _curr_month_margin(T):
    """Same month's margin for every grid row."""
    g = gp.margin_lookup(gp.category_date_spine(T), gp.monthly_margin(T), 0, "gp_percent_current_month")
    return g.select("category_items", "categ_id", "so_date", "so_month",
                    "gp_percent_current_month")


@query("gross_profit")
def _gross_profit(T):
    """The report."""
    return gp.gross_profit(T)


# ---- C: Order to cash ---------------------------------------------------------

TEXT_COLS = ["line_id", "picking_id", "move_product_id", "bundle_line_id", "product_code",
             "product_name", "bundle_name", "customer", "company_name", "receiver",
             "delivery_address", "incoterm", "shipping_note", "branch_delivery"]


@query("localized_names")
def _localized_names(T):
    """Localized product and incoterm names."""
    prod = product_names(T).select(F.lit("product").alias("kind"), F.col("tmpl_id").alias("ref_id"),
                                   F.col("product_name").alias("name"))
    inc = T["account_incoterms"].select(F.lit("incoterm").alias("kind"), F.col("id").alias("ref_id"),
                                        first_nonblank(localized("name")).alias("name"))
    return prod.unionByName(inc)


@query("first_payment")
def _first_payment(T):
    """Earliest posted payment per invoice (edge-union rewrite of the OR-joins)."""
    return o2c.first_payment(T)


@query("receivable_lines")
def _receivable_lines(T):
    """Semi-join of journal lines on receivable accounts."""
    return o2c.receivable_lines(T).select("id", "move_id", "account_id")


@query("deliveries")
def _deliveries(T):
    """C4: delivered quantity per line, picking, product and bundle line."""
    d = o2c.deliveries(T)
    return d.select("so_line_id", "picking_id", "picking_partner_id", "delivery_number", "delivery_date",
                    "delivery_status", "shipping_note", "branch_name", "move_product_id",
                    "move_product_code", "move_product_name", "line_type",
                    out("total_delivered_qty").alias("total_delivered_qty"), "bundle_line_id")


@query("line_type")
def _line_type(T):
    """Bundle / Standard per stock move."""
    sm = T["stock_move"]
    return sm.select(F.col("id").alias("move_id"), o2c.line_type(sm).alias("line_type"))


@query("shipping_note")
def _shipping_note(T):
    """Picking note with HTML tags stripped."""
    return T["stock_picking"].select(F.col("id").alias("picking_id"), strip_html("note").alias("shipping_note"))


@query("line_invoices")
def _line_invoices(T):
    """Distinct posted customer invoices per order line."""
    return o2c.line_invoices(T)


@query("text_fallbacks")
def _text_fallbacks(T):
    """Fallback text chains at the delivery grain (no invoice fan-out)."""
    return o2c.order_to_cash(T, keep_keys=True, with_invoices=False).select(*TEXT_COLS)


@query("row_id")
def _row_id(T):
    """Dense ordered row id over the order-to-cash rows (two-pass, parallel); only the keys are cut and sorted."""
    keys = ["line_id", "picking_id", "move_product_id", "bundle_line_id", "invoice_id"]
    return dense_row_id(o2c.order_to_cash(T, keep_keys=True).select(*keys), o2c.id_order()).select("id", *keys)


@query("order_to_cash")
def _order_to_cash(T):
    """C11: the report."""
    return o2c.order_to_cash(T)


# ---- E: filters, groups, footers, pivots, charts --------------------------------

GP_MEASURES = ["qty", "amount", "gp_percent", "total_gross_profit", "gp_percent_current_month"]
O2C_MEASURES = ["qty", "price_unit", "subtotal", "tax_amount", "total_amount", "delivered_qty"]
SC_MEASURES = ["sales_amount", "cogs", "gross_profit", "margin_percent", "sales_contribution_percent"]


def _preset_report(report: str, name: str):
    """Date preset turned into report bounds, so the window is applied to the
    orders before the joins (same rows as filtering the finished report)."""
    lo, hi, inclusive = preset_bounds(name, TODAY)
    if hi is not None and not inclusive:
        hi = hi - _dt.timedelta(days=1)
    return lambda T: REPORTS[report](T, date_from=lo, date_to=hi)


@query("date_range")
def _date_range(T):
    """Inclusive so_date window on Gross Profit (pushed below the joins)."""
    return gp.gross_profit(T, date_from=DATE_FROM, date_to=DATE_TO)


# each of the five presets on each of the three reports; the first report of a preset has the plain key
PRESET_KEYS = {"today": ("gp", "o2c", "sc"), "this_week": ("sc", "gp", "o2c"), "this_month": ("o2c", "gp", "sc"),
               "last_month": ("gp", "o2c", "sc"), "this_year": ("sc", "gp", "o2c")}
for _name, _reps in PRESET_KEYS.items():
    for _i, _rep in enumerate(_reps):
        query(f"preset_{_name}" + (f"_{_rep}" if _i else ""))(_preset_report(_rep, _name))

for _name in ("paid", "not_paid", "delivered", "not_delivered", "invoiced", "bundle", "standard"):
    query(f"preset_{_name}")(lambda T, _n=_name: filtered_report(T, "o2c", flt.Filters(status=(_n,))))


# E5: one key for each searchable field: contains on texts, equality on dates
SEARCHES = {"text_search": ("o2c", "product_name", "RED"), "search_gp_category": ("gp", "category_items", "brand#1"),
            "search_gp_date": ("gp", "so_date", "1998-06-15"), "search_gp_month": ("gp", "so_month", "1998-06-01"),
            "search_o2c_number": ("o2c", "so_number", "77"), "search_o2c_customer": ("o2c", "customer", "0001"),
            "search_o2c_company": ("o2c", "company_name", "9"), "search_o2c_salesperson": ("o2c", "salesperson", "2"),
            "search_o2c_code": ("o2c", "product_code", "p1"), "search_o2c_delivery": ("o2c", "delivery_number", "1"),
            "search_o2c_invoice": ("o2c", "invoice_number", "2"), "search_o2c_date": ("o2c", "po_date", "1998-06-15"),
            "search_sc_category": ("sc", "category", "BRAND#2"), "search_sc_date": ("sc", "so_date", "1998-06-15"),
            "search_sc_month": ("sc", "so_month", "1998-06-01")}
for _key, (_rep, _field, _value) in SEARCHES.items():
    query(_key)(lambda T, _r=_rep, _f=_field, _v=_value: filtered_report(T, _r, flt.Filters(search=((_f, _v),))))


@query("search_o2c_several")
def _search_o2c_several(T):
    """Several filters at once, routed through orders, pickings and invoices, then grouped."""
    some = flt.Filters(search=(("so_number", "7"), ("customer", "00"), ("delivery_number", "1"), ("invoice_number", "/")),
                       status=("invoiced", "standard"))
    rows = filtered_report(T, "o2c", some, DATE_FROM, DATE_TO, columns=["customer", "line_type", *O2C_MEASURES])
    return grp.group_report(rows, "customer", O2C_MEASURES)


def _columns(report: str, T, columns: list[str]):
    """A report for a query over some of its columns; order to cash then plans only their lookups."""
    return o2c.order_to_cash(T, columns=columns) if report == "o2c" else REPORTS[report](T)


for _key, _rep, _by, _grain, _ms in (
        ("group_gp_month", "gp", "so_month", "day", GP_MEASURES),
        ("group_gp_category", "gp", "category_items", "day", GP_MEASURES),
        ("group_gp_date", "gp", "so_date", "day", GP_MEASURES),
        ("group_o2c_date", "o2c", "po_date", "day", O2C_MEASURES),
        ("group_sc_date", "sc", "so_date", "day", SC_MEASURES),
        ("group_o2c_customer", "o2c", "customer", "day", O2C_MEASURES),
        ("group_o2c_salesperson", "o2c", "salesperson", "day", O2C_MEASURES),
        ("group_o2c_company", "o2c", "company_name", "day", O2C_MEASURES),
        ("group_o2c_branch", "o2c", "branch_delivery", "day", O2C_MEASURES),
        ("group_o2c_month", "o2c", "po_date", "month", O2C_MEASURES),
        ("group_o2c_year", "o2c", "po_date", "year", O2C_MEASURES),
        ("group_sc_month", "sc", "so_month", "day", SC_MEASURES),
        ("group_sc_category", "sc", "category", "day", SC_MEASURES)):
    query(_key)(lambda T, _r=_rep, _b=_by, _g=_grain, _m=_ms:
                grp.group_report(_columns(_r, T, [_b, *_m]), _b, _m, _g))

# E6 with E8: nested groups with the subtotals of every level and the total
query("group_gp_levels")(lambda T: grp.group_levels(
    gp.gross_profit(T), [F.col("so_month"), F.col("category_items"), F.col("so_date")], GP_MEASURES))
query("group_o2c_levels")(lambda T: grp.group_levels(
    _columns("o2c", T, ["customer", "po_date", *O2C_MEASURES]), [F.col("customer"), grp.group_key("po_date", "month")], O2C_MEASURES))
query("group_sc_sets")(lambda T: grp.group_levels(
    sc.sales_contribution(T), [F.col("category"), F.col("so_month")], SC_MEASURES, sets=[["category"], ["so_month"], []]))


query("footer_gp")(lambda T: grp.footer(gp.gross_profit(T), ["qty", "amount", "total_gross_profit"]))
query("footer_o2c")(lambda T: grp.footer(
    _columns("o2c", T, ["subtotal", "tax_amount", "total_amount"]), ["subtotal", "tax_amount", "total_amount"]))
query("footer_sc")(lambda T: grp.footer(sc.sales_contribution(T), ["sales_amount", "cogs", "gross_profit"]))


@query("pivot_gp")
def _pivot_gp(T):
    """Category x month cube of qty, amount, GP% and total GP."""
    return grp.pivot_long(gp.gross_profit(T), F.col("category_items"),
                          grp.group_key("so_date", "month"),
                          ["qty", "amount", "gp_percent", "total_gross_profit"])


@query("pivot_o2c")
def _pivot_o2c(T):
    """Customer x month cube of subtotal and qty."""
    return grp.pivot_long(_columns("o2c", T, ["customer", "po_date", "subtotal", "qty"]), F.col("customer"), grp.group_key("po_date", "month"),
                          ["subtotal", "qty"])


@query("pivot_gp_wide")
def _pivot_gp_wide(T):
    """E9 as a table: category rows, a column for each month of the window and measure."""
    return grp.pivot_wide(gp.gross_profit(T, DATE_FROM, DATE_TO), F.col("category_items"), F.col("so_month"),
                          ["qty", "amount", "gp_percent", "total_gross_profit"])


@query("pivot_o2c_wide")
def _pivot_o2c_wide(T):
    """E10 as a table: customer rows, a column for each month of the window and measure."""
    rows = o2c.order_to_cash(T, DATE_FROM, DATE_TO, columns=["customer", "po_date", "subtotal", "qty"])
    return grp.pivot_wide(rows, F.col("customer"), grp.group_key("po_date", "month"), ["subtotal", "qty"])


@query("pivot_sc")
def _pivot_sc(T):
    """Category rows with a total row."""
    return grp.pivot_rows(sc.sales_contribution(T), F.col("category"),
                          ["sales_amount", "cogs", "gross_profit", "margin_percent"])


query("chart_gp_bar")(lambda T: grp.chart_data(gp.gross_profit(T), F.col("category_items"), "total_gross_profit"))
query("chart_o2c_line")(lambda T: grp.chart_data(_columns("o2c", T, ["po_date", "subtotal"]), grp.group_key("po_date", "month"),
                                                 "subtotal"))
query("chart_sc_pie")(lambda T: grp.chart_data(sc.sales_contribution(T), F.col("category"), "sales_amount"))


# ---- F: export tables ------------------------------------------------------------

query("export_gp_mtd")(lambda T: ex.gross_profit_mtd(T, AS_OF))
query("export_gp_total")(lambda T: ex.gross_profit_total(T, AS_OF))
query("sales_run_rate")(lambda T: ex.sales_run_rate(T, AS_OF))
query("export_o2c")(lambda T: ex.order_to_cash_export(T, DATE_FROM, DATE_TO))
query("export_sc")(lambda T: ex.sales_contribution_export(T, DATE_FROM, DATE_TO))
query("export_sc_total")(lambda T: ex.sales_contribution_total(T, DATE_FROM, DATE_TO))


@query("map_delivery_status")
def _map_delivery_status(T):
    """delivery labels over every picking state."""
    return T["stock_picking"].select(F.col("id").alias("picking_id"), F.col("state"),
                                     delivery_status_label("state").alias("label"))


@query("map_invoice_status")
def _map_invoice_status(T):
    """F8: invoice labels over the orders' invoice_status (as the export feeds it)."""
    return T["sale_order"].select(F.col("id").alias("order_id"), F.col("invoice_status"),
                                  invoice_status_label("invoice_status").alias("label"))


@query("map_payment_state")
def _map_payment_state(T):
    """payment labels over every move's first-payment states (draft and posted)."""
    fp = o2c.first_payment(T, states=("draft", "posted"))
    mv = T["account_move"].select(F.col("id").alias("invoice_id"))
    x = mv.join(fp, "invoice_id", "left")
    st = F.coalesce(F.col("payment_states"), F.lit(""))
    return x.select("invoice_id", st.alias("payment_state"), payment_state_label(st).alias("label"))


# ---- G: line enrichments -------------------------------------------------------------

COST_COMPANY = "2"  # company whose cost is snapshotted (a fixed parameter)


@query("cost_snapshot")
def _cost_snapshot(T):
    """G1: product standard price per line for one company, 0.0 when missing."""
    return en.cost_snapshot(T["sale_order_line"], T["product_product"], COST_COMPANY)


def _cost_changes(T):
    """The tables before and after changes of products, prices and order states, with new lines and lines gone."""
    lines, orders, products = T["sale_order_line"], T["sale_order"], T["product_product"]
    before = T | {"sale_order_line": lines.where("pmod(order_id, 97) <> 1")}
    after = T | {
        "sale_order_line": lines.where("pmod(order_id, 89) <> 2").withColumn(
            "product_id", F.when(F.pmod("id", F.lit(1009)) == 0, F.col("product_id") + 1).otherwise(F.col("product_id"))),
        "sale_order": orders.withColumn("state", F.when(F.pmod("id", F.lit(50)) != 0, F.col("state")).when(
            F.col("state") == "sale", F.lit("done")).otherwise(F.lit("sale"))),
        "product_product": products.withColumn("standard_price", F.when(F.pmod("id", F.lit(3)) == 0, F.lit('{"2": 7}')).otherwise(
            F.col("standard_price")))}
    return before, after


@query("cost_snapshot_refresh")
def _cost_snapshot_refresh(T):
    """G1 stored: the cost of every line, taken, then refreshed after changes of products, prices and states."""
    spark = T["sale_order"].sparkSession
    path = shared_output_dir(spark, "cost-store")
    before, after = _cost_changes(T)
    cost_store.build(before, path, COST_COMPANY)
    cost_store.refresh(after, path, COST_COMPANY)
    return cost_store.read(spark, path)


@query("bundle_display")
def _bundle_display(T):
    """Bundle components text per line."""
    return en.bundle_display(T["sale_order_line"], T["sale_order_line_bundle"], T["product_product"],
                             T["product_template"])


@query("component_label")
def _component_label(T):
    """Display label of every bundle component."""
    return en.component_label(T["sale_order_line_bundle"], T["product_product"], T["product_template"],
                              T["uom_uom"])


# ---- A: scans, optional columns, views, sink, record reads ---------------------------


@query("scan_tables")
def _scan_tables(T):
    """A1: row count of every base table."""
    return table_counts(T)


@query("optional_columns")
def _optional_columns(T):
    """A2: effective order date with and without the optional custom-date column."""
    so = T["sale_order"]
    plain = so.drop("x_studio_date")
    return so.select(F.col("id").alias("order_id"),
                     effective_order_date(so).alias("date_with_custom"),
                     effective_order_date(plain).alias("date_without_custom"))


@query("optional_bundle")
def _optional_bundle(T):
    """A2: line type with and without the optional bundle column, per stock move."""
    sm = T["stock_move"]
    return sm.select(F.col("id").alias("move_id"), o2c.line_type(sm).alias("type_with_bundle"),
                     o2c.line_type(sm.drop("sale_bundle_line_id")).alias("type_without_bundle"))


@query("sink_order")
def _sink_order(T):
    """Place of every row in the order in which the sinks write Sales Contribution."""
    ordered = dense_row_id(sc.sales_contribution(T), sc.sink_order(), "place")
    return ordered.select("place", "category", "categ_id", "so_date", "sales_amount")


@query("export_all")
def _export_all(T):
    """the tables of a combined export with their row counts and a sum of each."""
    sheets = ex.export_all(T, ex.ExportParams.with_defaults(
        "all", as_of_date=_dt.date.fromisoformat(AS_OF), date_from=DATE_FROM, date_to=DATE_TO))
    measure = {"gross_profit": "amount", "gross_profit_total": "amount", "gross_profit_run_rate": "total_sales",
               "order_to_cash": "total_amount", "sales_contribution": "sales_amount", "sales_contribution_total": "sales_amount"}
    parts = [grp.footer(df.select(F.col(measure[name]).alias("total")), ["total"]).select(F.lit(name).alias("sheet"), "row_count", "total")
             for name, df in sheets.items()]
    return reduce(DataFrame.unionByName, parts)


def _late_orders(T):
    """The tables before late and changed orders came, and those orders' rows as they were and as they are."""
    of = lambda df, col, *rest: df.where(F.pmod(F.col(col), F.lit(10)).isin(*rest))
    kind = {f.name: f.dataType for f in T["sale_order_line"].schema}
    changed = F.pmod("order_id", F.lit(10)) == 3
    was = lambda c, v: F.when(changed, v).otherwise(F.col(c)).cast(kind[c]).alias(c)
    lines = T["sale_order_line"].withColumns({"product_uom_qty": was("product_uom_qty", F.col("product_uom_qty") + 1),
                                              "price_subtotal": was("price_subtotal", F.col("price_subtotal") / 2)})
    orders = T["sale_order"].withColumn("state", F.when(F.pmod("id", F.lit(20)) == 3, F.lit("draft")).otherwise(F.col("state")))
    early = T | {"sale_order": of(orders, "id", 0, 1, 2, 3, 4, 5, 6, 8, 9), "sale_order_line": of(lines, "order_id", 0, 1, 2, 3, 4, 5, 6, 8, 9)}
    before = T | {"sale_order": of(orders, "id", 3), "sale_order_line": of(lines, "order_id", 3)}
    after = T | {"sale_order": of(T["sale_order"], "id", 3, 7), "sale_order_line": of(T["sale_order_line"], "order_id", 3, 7)}
    return early, before, after


def _from_state(read):
    """A3, B4, D1 materialised: daily sums built, a delta of late and changed orders added, the report read from them."""
    def run(T):
        path = shared_output_dir(T["sale_order"].sparkSession, "daily-sums")
        early, before, after = _late_orders(T)
        state.build(early, path)
        state.add_delta(before, after, path)
        return read(T, path)
    return run


query("state_gross_profit")(_from_state(state.gross_profit))
query("state_sales_contribution")(_from_state(state.sales_contribution))
query("state_preset_today_gp")(_from_state(lambda T, path: state.gross_profit(T, path, TODAY, TODAY)))
query("state_preset_today_sc")(_from_state(lambda T, path: state.sales_contribution(T, path, TODAY, TODAY)))


@query("stored_scan")
def _stored_scan(T):
    """A1, A2 on stored tables: parts with and without the optional columns, quantities of different digits and an
    extra column, loaded as one table each."""
    spark = T["sale_order"].sparkSession
    path = shared_output_dir(spark, "tables")
    so, sol, sm = T["sale_order"], T["sale_order_line"], T["stock_move"]
    half = lambda df, k: df.where(F.pmod("id", F.lit(2)) == k)
    parts = {"sale_order": (half(so, 0).drop("x_studio_date"), half(so, 1).withColumn("note", F.lit("later"))),
             "sale_order_line": (half(sol, 0), half(sol, 1).withColumn("product_uom_qty", F.col("product_uom_qty").cast("decimal(24,6)"))),
             "stock_move": (half(sm, 0).drop("sale_bundle_line_id"), half(sm, 1))}
    for name, dfs in parts.items():
        for k, df in enumerate(dfs):
            df.write.parquet(f"{path}/{name}/part={k}")
    S = load_tables(spark, path, tables=tuple(parts), parts=True)
    so, sol, sm = (S[t] for t in parts)
    return reduce(DataFrame.unionByName, (
        so.select(F.lit("sale_order").alias("table_name"), "id", effective_order_date(so).cast("string").alias("value")),
        sol.select(F.lit("sale_order_line").alias("table_name"), "id", F.col("product_uom_qty").cast("decimal(18,2)").cast("string").alias("value")),
        sm.select(F.lit("stock_move").alias("table_name"), "id", o2c.line_type(sm).alias("value"))))


@query("sink_commit")
def _sink_commit(T):
    """A4 committed: Sales Contribution by month, then the window's months replaced by their recomputed rows."""
    spark = T["sale_order"].sparkSession
    path = shared_output_dir(spark, "committed")
    committed.commit(sc.sales_contribution(T), path, ["so_month"])
    window = sc.sales_contribution(T, DATE_FROM, DATE_TO)
    for _ in range(2):  # the repeated commit changes nothing
        committed.commit(window, path, ["so_month"], "partitions", commit_id="window")
    return committed.read_committed(spark, path).select(*sc.COLUMNS)


STORED_IDS = [5, 1, 2, 400, 401, 9999, 3, 20000, 27000, 999_999_999]


@query("read_records_stored")
def _read_records_stored(T):
    """A5 stored: ten records read from the files that hold their ids."""
    spark = T["sale_order"].sparkSession
    path = shared_output_dir(spark, "numbered")
    numbered.store_numbered(sc.sales_contribution(T, with_id=True), path)
    r = numbered.read_stored(spark, path, STORED_IDS, ["category", "so_date", "sales_amount", "categ_id"],
                             {"categ_id": (T["product_category"], "name")})
    return r.select("pos", "id", "category", "so_date", "sales_amount", F.col("categ_id.id").alias("categ_ref_id"),
                    F.col("categ_id.display_name").alias("categ_ref_name"))


@query("report_views")
def _report_views(T):
    """A3: the three reports registered as views and queried through SQL."""
    spark = T["sale_order"].sparkSession
    v = register_reports(spark, T)
    return spark.sql(
        f"SELECT 'gross_profit' AS report, COUNT(*) AS row_count, "
        f"CAST(SUM(CAST(amount AS DECIMAL(38,6))) AS DOUBLE) AS total FROM {v['gross_profit']} "
        f"UNION ALL SELECT 'order_to_cash', COUNT(*), "
        f"CAST(SUM(CAST(subtotal AS DECIMAL(38,6))) AS DOUBLE) FROM {v['order_to_cash']} "
        f"UNION ALL SELECT 'sales_contribution', COUNT(*), "
        f"CAST(SUM(CAST(sales_amount AS DECIMAL(38,6))) AS DOUBLE) FROM {v['sales_contribution']}")


@query("sink_roundtrip")
def _sink_roundtrip(T):
    """A4: Sales Contribution written as parquet partitioned by month (in report
    order) to the shared folder, then read back."""
    spark = T["sale_order"].sparkSession
    path = shared_output_dir(spark)
    write_report(sc.sales_contribution(T), path, "parquet", partition_by=["so_month"],
                 order=sc.sink_order())
    return read_report(spark, path, "parquet").select(*sc.COLUMNS)


@query("read_records")
def _read_records(T):
    """A5: every Sales Contribution id plus two ids past the end, newest first,
    with the category reference resolved to (id, display_name)."""
    spark = T["sale_order"].sparkSession
    rep = sc.sales_contribution(T, with_id=True)
    n = rep.count()
    ids = spark.range(1, n + 3).select(F.col("id"), (F.lit(n + 3) - F.col("id")).alias("pos"))
    cats = T["product_category"]
    r = read_records(rep, ids, ["category", "so_date", "sales_amount", "categ_id"],
                     {"categ_id": (cats, "name")})
    return r.select("pos", "id", "category", "so_date", "sales_amount",
                    F.col("categ_id.id").alias("categ_ref_id"),
                    F.col("categ_id.display_name").alias("categ_ref_name"))
