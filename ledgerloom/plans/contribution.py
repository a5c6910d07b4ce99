"""Sales Contribution report (D1-D5): sales, COGS and margin per category and
day, with each category's share of the day's sales.

Plan: order lines join valid orders (shuffle on order id, or broadcast when AQE
sees a small side) and are summed per (product, day); the product -> category
map meets only that aggregate, then (category, day) is aggregated; the per-day
total is a window over that small aggregate instead of a second aggregation
joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.money import dbl, out, safe_ratio
from ..operators.row_id import dense_row_id
from .common import Tables, category_label, product_categories, valid_orders

COLUMNS = ["category", "categ_id", "so_date", "so_month", "sales_amount", "cogs",
           "gross_profit", "margin_percent", "sales_contribution_percent"]


def dated_lines(T: Tables, date_from=None, date_to=None) -> DataFrame:
    """Lines of valid orders by product and plain order date (never the custom date), section/note lines included:
    ``sales`` and ``cogs`` of the line."""
    orders = valid_orders(T, date_from, date_to, custom_date=False, date_col="so_date")
    lines = T["sale_order_line"].select(
        "order_id", "product_id", F.col("price_subtotal").alias("sales"),
        (dbl("product_uom_qty") * F.coalesce(dbl("purchase_price"), F.lit(0.0))).alias("cogs"))
    return lines.join(orders, "order_id").select("product_id", "so_date", "sales", "cogs")


def by_category(T: Tables, per_product: DataFrame) -> DataFrame:
    """D1 from sums per (product, day)."""
    agg = (per_product.join(product_categories(T), "product_id", "left")
           .groupBy("pc_id", "categ_name", "so_date")
           .agg(F.sum("sales").alias("sales"), F.sum("cogs").alias("cogs")))
    return agg.select(
        category_label("categ_name").alias("category"),
        F.coalesce(F.col("pc_id"), F.lit(0)).cast("long").alias("categ_id"),
        "so_date",
        month_start("so_date").alias("so_month"),
        "sales", "cogs", (dbl("sales") - F.col("cogs")).alias("profit"))


def category_sales(T: Tables, date_from=None, date_to=None) -> DataFrame:
    """Sales (exact) and costs per (category id, category name, order date).

    Uses the plain order date (never the custom date) and keeps section/note
    lines; uncategorised sales are kept under categ_id 0.  Lines are summed per
    (product, day) first (map-side combined), then categories are looked up."""
    return by_category(T, dated_lines(T, date_from, date_to).groupBy("product_id", "so_date").agg(
        F.sum("sales").alias("sales"), F.sum("cogs").alias("cogs")))


def with_daily_totals(cs: DataFrame) -> DataFrame:
    """Attach the day's total sales to every category row.  A window over
    the (category, day) aggregate -- at most one row per category per day --
    replaces the reference's second aggregation joined back; the inner join
    it replaces drops NULL dates, so they are dropped here too."""
    return (cs.where(F.col("so_date").isNotNull())
            .withColumn("day_total", F.sum("sales").over(Window.partitionBy("so_date"))))


def sales_contribution(T: Tables, date_from=None, date_to=None, with_id: bool = False) -> DataFrame:
    """The report.  Row order (so_date desc, sales desc) is applied only
    at the sink; ``with_id`` numbers rows in that order with tie-breakers."""
    rep = shares_of_day(category_sales(T, date_from, date_to))
    if with_id:
        rep = dense_row_id(rep, report_order())
        rep = rep.select("id", *COLUMNS)
    return rep


def shares_of_day(cs: DataFrame) -> DataFrame:
    """D2-D4 over category-day sums."""
    day_total = F.col("day_total")
    return with_daily_totals(cs).select(
        "category", "categ_id", "so_date", "so_month",
        out("sales").alias("sales_amount"),
        "cogs", F.col("profit").alias("gross_profit"),
        safe_ratio("profit", "sales").alias("margin_percent"),
        safe_ratio("sales", day_total).alias("sales_contribution_percent"))


def report_order():
    """Row-id order: the report's own ordering (day desc, sales desc) with tie-breakers."""
    return [F.col("so_date").desc_nulls_first(), F.col("sales_amount").desc_nulls_first(),
            F.col("category").asc_nulls_last(), F.col("categ_id").asc_nulls_last()]


def sink_order():
    """Default record order of the report (day desc, category) with a tie-breaker."""
    return [F.col("so_date").desc_nulls_first(), F.col("category").asc_nulls_last(),
            F.col("categ_id").asc_nulls_last()]
