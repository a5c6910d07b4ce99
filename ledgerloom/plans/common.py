"""Pieces shared by the report jobs: valid orders, product -> category, names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import effective_order_date, order_date_window
from ..functions.text import first_nonblank, localized
from ..operators.filters import date_range

Tables = dict[str, DataFrame]

# Order states that count as sales, invoice type/state that count as revenue.
VALID_ORDER_STATES = ("sale", "done")
CUSTOMER_INVOICE = "out_invoice"
POSTED = "posted"
RECEIVABLE = "asset_receivable"
UNCATEGORIZED = "Uncategorized"


def valid_orders(T: Tables, date_from: dt.date | str | None = None,
                 date_to: dt.date | str | None = None, custom_date: bool = True,
                 date_col: str = "order_date", extra: list[str] | None = None) -> DataFrame:
    """Confirmed/done orders with their effective date (B1, B2), optionally
    limited to ``[date_from, date_to]`` before any join."""
    so = T["sale_order"]
    d = effective_order_date(so) if custom_date else F.to_date("date_order")
    window = order_date_window(so, date_from, date_to, "x_studio_date" if custom_date else None)
    if window is not None:  # same rows, but in a form the scan can use
        so = so.where(window)
    out = so.where(F.col("state").isin(*VALID_ORDER_STATES)).select(
        F.col("id").alias("order_id"), d.alias(date_col), *(extra or []))
    return date_range(out, date_col, date_from, date_to)


def product_categories(T: Tables) -> DataFrame:
    """product id -> (category id, raw category name); NULLs when the product has
    no template/category.  Join strategy is left to the planner: a side is
    broadcast only when its estimated (or, under AQE, measured) size is under
    the broadcast threshold, otherwise the join stays a sort-merge join."""
    pp = T["product_product"].select(F.col("id").alias("product_id"), "product_tmpl_id")
    pt = T["product_template"].select(F.col("id").alias("product_tmpl_id"), "categ_id")
    pc = T["product_category"].select(
        F.col("id").alias("categ_id"), F.col("id").alias("pc_id"), F.col("name").alias("categ_name"))
    # pc_id is NULL when the template has no category or points at a missing one
    return (pp.join(pt, "product_tmpl_id", "left")
            .join(pc, "categ_id", "left")
            .select("product_id", "pc_id", "categ_name"))


def category_label(name: Column | str) -> Column:
    """Trimmed category name, 'Uncategorized' when NULL or blank."""
    return first_nonblank(name, default=UNCATEGORIZED)


def product_names(T: Tables, lang: str = "en_US") -> DataFrame:
    """Template id -> trimmed localized name, '' when missing."""
    pt = T["product_template"]
    return pt.select(F.col("id").alias("tmpl_id"),
                     first_nonblank(localized("name", lang), default="").alias("product_name"))


def product_dim(T: Tables, prefix: str) -> DataFrame:
    """``{prefix}_product_id``, ``_code``, ``_name``: built at the product grain, so that
    a fact table meets one product table, not products and templates in turn."""
    pp = T["product_product"].select(F.col("id").alias(f"{prefix}_product_id"),
                                     F.col("default_code").alias(f"{prefix}_product_code"),
                                     F.col("product_tmpl_id").alias("tmpl_id"))
    return (pp.join(product_names(T), "tmpl_id", "left").drop("tmpl_id")
            .withColumnRenamed("product_name", f"{prefix}_product_name"))
