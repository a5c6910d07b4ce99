"""Gross Profit report (B1-B13): dense category x day grid of order sales,
valued with the previous calendar month's invoiced margin of the category.

Plan shape:
* daily sales: lines join valid orders and are summed per (product, day)
  (partial + final aggregation), then the product -> category map is joined to
  that aggregate and a second, small aggregation gives (category, day);
* monthly margin: posted customer-invoice lines join the line/invoice junction
  and the order line, summed per (product, month) with the cost fallback split
  off, then per (category, month) -- a table bounded by categories x
  months, which AQE broadcasts into the two lookups;
* the grid: distinct valid order dates (bounded by the calendar) x the
  category dimension (broadcast by the planner's size check).  It is the report's
  defined grain, not an intermediate blow-up: its size equals the output.

Faithful quirks: uncategorised sales never reach the grid (its NULL key does
not equal NULL), lines of type section/note are dropped, an invoice line linked
to two order lines counts twice, refunds are ignored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.jsonmap import json_first_value
from ..functions.literal import literal_table
from ..functions.money import dbl, out, out_product, safe_ratio
from ..operators.row_id import dense_row_id
from .common import (CUSTOMER_INVOICE, POSTED, UNCATEGORIZED, Tables, category_label,
                     product_categories, valid_orders)

COLUMNS = ["category_items", "categ_id", "so_date", "so_month", "qty", "amount",
           "gp_percent", "total_gross_profit", "gp_percent_current_month"]


def _d(x):
    return None if x is None else (x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)))


def category_dim(T: Tables) -> DataFrame:
    """Every category (trimmed name or 'Uncategorized', id) plus an unkeyed
    'Uncategorized' member; UNION semantics (distinct)."""
    spark = T["product_category"].sparkSession
    cats = T["product_category"].select(category_label("name").alias("category_items"),
                                        F.col("id").alias("categ_id"))
    extra = literal_table(spark, [(UNCATEGORIZED, None)], "category_items string, categ_id long")
    return cats.unionByName(extra).distinct()


def product_day_sales(T: Tables, date_from=None, date_to=None, custom_date: bool = True) -> DataFrame:
    """Qty and amount per (product, order date); section/note lines removed.  Lines are summed at this grain first
    -- map-side combined, so the product -> category lookup runs on that much smaller table instead of
    shuffling every line by product."""
    orders = valid_orders(T, date_from, date_to, custom_date=custom_date, date_col="so_date")
    dt_ = F.col("display_type")
    lines = (T["sale_order_line"].where(dt_.isNull() | (dt_ == ""))
             .select("order_id", "product_id", "product_uom_qty", "price_subtotal"))
    return (lines.join(orders, "order_id")
            .groupBy("product_id", "so_date")
            .agg(F.sum("product_uom_qty").alias("qty"), F.sum("price_subtotal").alias("amount")))


def by_category(T: Tables, per_product: DataFrame) -> DataFrame:
    """B4 from sums per (product, day): qty and amount per (category, day)."""
    agg = (per_product.join(product_categories(T), "product_id", "left")
           .groupBy("pc_id", "categ_name", "so_date")
           .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount")))
    return agg.select(category_label("categ_name").alias("category_items"),
                      F.col("pc_id").alias("categ_id"), "so_date",
                      month_start("so_date").alias("so_month"), "qty", "amount")


def daily_category_sales(T: Tables, date_from=None, date_to=None,
                         custom_date: bool = True) -> DataFrame:
    """Qty and amount per (category, order date); section/note lines removed."""
    return by_category(T, product_day_sales(T, date_from, date_to, custom_date))


def invoiced_lines(T: Tables, month_from=None, month_to=None, few_lines: bool = False) -> DataFrame:
    """Posted customer-invoice lines joined with the order lines they bill: product, month, revenue, quantity and
    the line's non-zero cost.  With ``few_lines`` the joins start from the order lines, so that only journal lines of
    those go on to their invoices."""
    am = T["account_move"].where((F.col("move_type") == CUSTOMER_INVOICE) & (F.col("state") == POSTED))
    if month_from is not None:
        am = am.where(F.col("invoice_date") >= F.lit(_d(month_from)))
    if month_to is not None:
        am = am.where(F.col("invoice_date") < F.add_months(F.lit(_d(month_to)), 1))
    am = am.select(F.col("id").alias("move_id"), month_start("invoice_date").alias("inv_month"))
    aml = T["account_move_line"].select(F.col("id").alias("invoice_line_id"), "move_id",
                                        "quantity", "price_subtotal")
    rel = T["sale_order_line_invoice_rel"].select("order_line_id", "invoice_line_id")
    sol = T["sale_order_line"].select(F.col("id").alias("order_line_id"), "product_id", "purchase_price")
    if few_lines:
        billed = rel.join(sol, "order_line_id").join(aml, "invoice_line_id").join(am, "move_id")
    else:
        billed = aml.join(am, "move_id").join(rel, "invoice_line_id").join(sol, "order_line_id")
    return (billed
            .select("product_id", "inv_month", F.col("price_subtotal").alias("revenue"), dbl("quantity").alias("quantity"),
                    F.nullif(F.col("purchase_price").cast("double"), F.lit(0.0)).alias("line_cost")))


def margin_of(T: Tables, per_product: DataFrame) -> DataFrame:
    """B5 from sums per (product, month): ``revenue``, ``costed`` (quantity x line cost) and ``uncosted_qty``."""
    prices = T["product_product"].select(F.col("id").alias("product_id"),
                                         json_first_value("standard_price").cast("double").alias("price"))
    uncosted = F.col("uncosted_qty") * F.coalesce(F.col("price"), F.lit(0.0))
    # NULL when every quantity is: the month's ratio is then unknown, not 1
    cost = F.coalesce(F.col("costed") + uncosted, F.col("costed"), uncosted)
    x = (per_product.join(prices, "product_id", "left")
         .join(product_categories(T), "product_id", "left"))
    agg = x.groupBy("pc_id", "categ_name", "inv_month").agg(
        F.sum("revenue").alias("revenue"), F.sum(cost).alias("cost"))
    return agg.select(
        category_label("categ_name").alias("category_items"),
        F.col("pc_id").alias("categ_id"), "inv_month",
        safe_ratio(dbl("revenue") - F.col("cost"), "revenue").alias("gp_percent_accounting"))


def monthly_margin(T: Tables, month_from=None, month_to=None) -> DataFrame:
    """Margin ratio per (category, invoice month) from posted customer
    invoices; 0 when revenue is not positive.  ``month_from``/``month_to``
    (first days of months) restrict the invoices read.

    Unit cost = non-zero line cost, else the first value of the product's JSON
    cost map (jsonb key order), else 0.  As the fallback price belongs to the
    product, the cost sum splits into sum(qty x line cost) over lines
    with a cost plus price x sum(qty) over the others, so invoice lines are
    summed per (product, month) before the product/category lookup."""
    cost, quantity = F.col("line_cost"), F.col("quantity")
    return margin_of(T, invoiced_lines(T, month_from, month_to).groupBy("product_id", "inv_month").agg(
        F.sum("revenue").alias("revenue"), F.sum(quantity * cost).alias("costed"),
        F.sum(F.when(cost.isNull(), quantity)).alias("uncosted_qty")))


def order_dates(T: Tables, date_from=None, date_to=None, custom_date: bool = True) -> DataFrame:
    """Distinct valid order dates (bounded by the calendar)."""
    return (valid_orders(T, date_from, date_to, custom_date=custom_date, date_col="so_date")
            .select("so_date").distinct())


def category_date_spine(T: Tables, date_from=None, date_to=None, custom_date: bool = True) -> DataFrame:
    """Every category x every valid order date, with its month.

    Both inputs are dimensions (categories; calendar days), so the grid is
    bounded by |categories| x |days| whatever the fact volume.  The planner
    broadcasts the category side only when its size (estimated, then measured
    by AQE) is under the broadcast threshold; past it Spark runs a partitioned
    Cartesian product instead."""
    return grid_of(T, order_dates(T, date_from, date_to, custom_date))


def grid_of(T: Tables, dates: DataFrame) -> DataFrame:
    """B7 over given order dates."""
    return (dates.crossJoin(category_dim(T))
            .select("category_items", "categ_id", "so_date", month_start("so_date").alias("so_month")))


def _same_category(a: str, b: str) -> F.Column:
    # plain equality: the unkeyed 'Uncategorized' row (NULL id) never matches
    return ((F.col(f"{a}.category_items") == F.col(f"{b}.category_items"))
            & (F.col(f"{a}.categ_id") == F.col(f"{b}.categ_id")))


def spine_fill(spine: DataFrame, sales: DataFrame) -> DataFrame:
    """Grid LEFT JOIN daily sales on (name, id, date); missing -> 0."""
    s, d = spine.alias("s"), sales.alias("d")
    zero = F.lit(0)
    return (s.join(d, _same_category("s", "d") & (F.col("s.so_date") == F.col("d.so_date")), "left")
            .select("s.*", F.coalesce(F.col("d.qty"), zero).alias("qty"),
                    F.coalesce(F.col("d.amount"), zero).alias("amount")))


def margin_lookup(df: DataFrame, margin: DataFrame, months_back: int, name: str) -> DataFrame:
    """Margin of the month ``months_back`` calendar months before the
    row's month (an equi-join on the shifted month, not a row lag: a month
    without invoices gives 0)."""
    g, m = df.alias("g"), margin.alias("m")
    target = F.add_months(F.col("g.so_month"), -months_back) if months_back else F.col("g.so_month")
    return (g.join(m, _same_category("g", "m") & (F.col("m.inv_month") == target), "left")
            .select("g.*", F.coalesce(F.col("m.gp_percent_accounting"), F.lit(0.0)).alias(name)))


def margin_months(lo, hi) -> tuple[dt.date | None, dt.date | None]:
    """The invoice months that a window of days needs: the month before its first day's through its last day's."""
    lo, hi = _d(lo), _d(hi)
    return (None if lo is None else (lo.replace(day=1) - dt.timedelta(days=1)).replace(day=1),
            None if hi is None else hi.replace(day=1))


def valued_grid(spine: DataFrame, sales: DataFrame, margin: DataFrame) -> DataFrame:
    """The grid filled with sales and valued with the two margins."""
    g = spine_fill(spine, sales)
    g = margin_lookup(g, margin, 1, "gp_prev")
    g = margin_lookup(g, margin, 0, "gp_curr")
    return g.select(
        "category_items", "categ_id", "so_date", "so_month",
        out("qty").alias("qty"),
        out("amount").alias("amount"),
        F.col("gp_prev").alias("gp_percent"),
        out_product(dbl("amount") * F.col("gp_prev")).alias("total_gross_profit"),
        F.col("gp_curr").alias("gp_percent_current_month"))


def gross_profit(T: Tables, date_from=None, date_to=None, with_id: bool = False,
                 custom_date: bool = True) -> DataFrame:
    """The report.  Optional ``[date_from, date_to]`` is applied to the
    orders before any join; invoices are then read only for the months the
    window needs (previous month of ``date_from`` through month of ``date_to``)."""
    lo, hi = _d(date_from), _d(date_to)
    rep = valued_grid(category_date_spine(T, lo, hi, custom_date),
                      daily_category_sales(T, lo, hi, custom_date).drop("so_month"),
                      monthly_margin(T, *margin_months(lo, hi)))
    if with_id:
        rep = dense_row_id(rep, report_order()).select("id", *COLUMNS)
    return rep


def report_order():
    return [F.col("so_date").desc_nulls_first(), F.col("category_items").asc_nulls_last(),
            F.col("categ_id").asc_nulls_last()]
