"""Export tables (F1-F10): the spreadsheet content as DataFrames.

The reference fetches report rows to the application and aggregates them in a
Python loop; here every total is a DataFrame aggregate, so nothing but the
final (small) result leaves the executors.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import delivery_status_label, invoice_status_label, payment_state_label
from ..functions.money import nonzero_ratio
from ..operators.grouping import MEASURE_SUM
from ..sources.staging import at_once, stage
from .common import Tables
from .contribution import sales_contribution
from .gross_profit import daily_category_sales, margin_lookup, monthly_margin
from .order_to_cash import order_to_cash

REPORT_TYPES = ("gross_profit", "order_to_cash", "sales_contribution", "all")
TOTAL_LABEL = "TOTAL"


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def _sum(c: str):
    return F.sum(F.col(c).cast(MEASURE_SUM))


def gross_profit_mtd(T: Tables, as_of) -> DataFrame:
    """month-to-date Gross Profit per category *name* (first of month ..
    as_of), categories with zero amount and zero qty dropped, GP% weighted by
    amount.  The date window is pushed into the report build."""
    as_of = _d(as_of)
    first = as_of.replace(day=1)
    month_before = (first - dt.timedelta(days=1)).replace(day=1)
    # the grid's zero rows add nothing to the sums, so the sales are valued directly;
    # sales without a category never reach the grid and are left out here as well
    sales = daily_category_sales(T, first, as_of).where(F.col("categ_id").isNotNull())
    rep = margin_lookup(sales, monthly_margin(T, month_before, month_before), 1, "gp_percent")
    rep = rep.withColumn("total_gross_profit", F.col("amount").cast("double") * F.col("gp_percent"))
    g = rep.groupBy("category_items").agg(_sum("qty").alias("qty"), _sum("amount").alias("amount"),
                                          _sum("total_gross_profit").alias("total_gross_profit"))
    g = g.where(~((F.col("amount") == 0) & (F.col("qty") == 0)))
    return g.select("category_items", F.col("qty").cast("double").alias("qty"),
                    F.col("amount").cast("double").alias("amount"),
                    nonzero_ratio("total_gross_profit", "amount").alias("gp_percent"),
                    F.col("total_gross_profit").cast("double").alias("total_gross_profit"))


def gross_profit_total(T: Tables, as_of, mtd: DataFrame | None = None) -> DataFrame:
    """TOTAL row over the kept categories (qty is left blank, as in the sheet), from
    ``gross_profit_mtd``'s rows when they are at hand."""
    m = gross_profit_mtd(T, as_of) if mtd is None else mtd
    t = m.agg(_sum("amount").alias("amount"), _sum("total_gross_profit").alias("total_gross_profit"))
    return t.select(F.lit(TOTAL_LABEL).alias("category_items"),
                    F.coalesce(F.col("amount"), F.lit(0)).cast("double").alias("amount"),
                    nonzero_ratio("total_gross_profit", "amount").alias("gp_percent"),
                    F.coalesce(F.col("total_gross_profit"), F.lit(0)).cast("double")
                    .alias("total_gross_profit"))


def sales_run_rate(T: Tables, as_of, mtd: DataFrame | None = None) -> DataFrame:
    """daily average of month-to-date sales and the full-month estimate."""
    as_of = _d(as_of)
    t = gross_profit_total(T, as_of, mtd)
    day = F.dayofmonth(F.lit(as_of))
    days = F.dayofmonth(F.last_day(F.lit(as_of)))
    avg = F.when(day > 0, F.col("amount") / day).otherwise(F.lit(0.0))
    return t.select(F.lit(as_of).alias("as_of_date"), F.col("amount").alias("total_sales"),
                    day.alias("day_of_month"), days.alias("days_in_month"),
                    avg.alias("daily_avg"), (avg * days).alias("sales_estimate"))


# Export column names (the sheet's headers in snake case) and order.
O2C_EXPORT = [
    ("so_number", "so_number"), ("po_date", "po_date"), ("customer", "customer"),
    ("company", "company_name"), ("customer_po", "customer_po_number"), ("salesperson", "salesperson"),
    ("item_code", "product_code"), ("product", "product_name"), ("bundle_name", "bundle_name"),
    ("line_type", "line_type"), ("qty", "qty"), ("price_unit", "price_unit"),
    ("subtotal_before_tax", "subtotal"), ("tax", "tax_amount"), ("total_amount", "total_amount"),
    ("delivery_date_so", "so_delivery_date"), ("delivery_no", "delivery_number"),
    ("delivery_date_do", "delivery_date"), ("delivery_status", "delivery_status"),
    ("delivered_qty", "delivered_qty"), ("delivery_address", "delivery_address"),
    ("branch", "branch_delivery"), ("receiver", "receiver"), ("franco", "franco"),
    ("incoterm", "incoterm"), ("incoterm_location", "incoterm_location"),
    ("shipping_note", "shipping_note"), ("invoice_status", "invoice_status"),
    ("invoice_no", "invoice_number"), ("invoice_date", "invoice_date"),
    ("payment_state", "payment_state"), ("payment_date", "payment_date"),
]
_TEXT = {"so_number", "customer", "company", "customer_po", "salesperson", "item_code", "product",
         "bundle_name", "delivery_no", "delivery_address", "branch", "receiver", "franco", "incoterm",
         "incoterm_location", "shipping_note", "invoice_no"}
_NUM = {"qty", "price_unit", "subtotal_before_tax", "tax", "total_amount", "delivered_qty"}


def order_to_cash_export(T: Tables, date_from=None, date_to=None) -> DataFrame:
    """the 32 export columns over the po_date window, statuses mapped to
    labels, empty text -> '', empty numbers -> 0, line type defaulting to
    'Standard'; dates stay dates (NULL when empty)."""
    rep = order_to_cash(T, date_from, date_to)
    cols = []
    for name, src in O2C_EXPORT:
        c = F.col(src)
        if name == "delivery_status":
            c = delivery_status_label(c)
        elif name == "invoice_status":
            c = invoice_status_label(c)
        elif name == "payment_state":
            c = payment_state_label(c)
        elif name == "line_type":
            c = F.when(F.coalesce(c, F.lit("")) == "", F.lit("Standard")).otherwise(c)
        elif name in _TEXT:
            c = F.coalesce(c, F.lit(""))
        elif name in _NUM:
            c = F.coalesce(c, F.lit(0.0))
        cols.append(c.alias(name))
    return rep.select(*cols)


SC_EXPORT = ["category", "sales_amount", "cogs", "gross_profit", "margin_percent",
             "sales_contribution_percent"]


def sales_contribution_export(T: Tables, date_from=None, date_to=None) -> DataFrame:
    """one row per category-day of the window (the sheet shows no date)."""
    rep = sales_contribution(T, date_from, date_to)
    return rep.select(F.coalesce("category", F.lit("")).alias("category"),
                      *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SC_EXPORT[1:]])


def sales_contribution_total(T: Tables, date_from=None, date_to=None, rows: DataFrame | None = None) -> DataFrame:
    """TOTAL row: sums, overall margin, share fixed at 1.0; over the exported ``rows`` when they are at hand."""
    e = sales_contribution_export(T, date_from, date_to) if rows is None else rows
    t = e.agg(_sum("sales_amount").alias("s"), _sum("cogs").alias("c"), _sum("gross_profit").alias("g"))
    zero = F.lit(0)
    return t.select(F.lit(TOTAL_LABEL).alias("category"),
                    F.coalesce("s", zero).cast("double").alias("sales_amount"),
                    F.coalesce("c", zero).cast("double").alias("cogs"),
                    F.coalesce("g", zero).cast("double").alias("gross_profit"),
                    nonzero_ratio("g", "s").alias("margin_percent"),
                    F.lit(1.0).alias("sales_contribution_percent"))


@dataclass(frozen=True)
class ExportParams:
    """wizard parameters; defaults are today's date, as in the wizard."""
    report_type: str = "all"
    as_of_date: dt.date | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None

    @classmethod
    def with_defaults(cls, report_type: str = "all", today: dt.date | None = None, **kw):
        t = today or dt.date.today()
        base = {"as_of_date": t, "date_from": t, "date_to": t}
        base.update({k: v for k, v in kw.items() if v is not None})
        return cls(report_type=report_type, **base)

    def validate(self) -> None:
        if self.report_type not in REPORT_TYPES:
            raise ValueError(f"report_type must be one of {REPORT_TYPES}")
        if self.report_type in ("gross_profit", "all") and not self.as_of_date:
            raise ValueError("as_of_date is required for the Gross Profit export")
        if self.report_type in ("order_to_cash", "sales_contribution", "all"):
            if not self.date_from or not self.date_to:
                raise ValueError("date_from and date_to are required for this export")


def export_name(report_type: str, as_of: dt.date | None = None) -> str:
    """A name for an export, of its kind and its day as text."""
    return f"export_{report_type}_{as_of or dt.date.today():%Y%m%d}"


def export_all(T: Tables, params: ExportParams) -> dict[str, DataFrame]:
    """the tables of one export run, keyed by sheet.

    A report's rows are computed once, staged, and its totals read from there: the order lines are scanned once for
    each report, however many sheets it fills."""
    params.validate()
    out: dict[str, DataFrame] = {}
    rt = params.report_type
    wanted = {
        "gross_profit": lambda: stage(gross_profit_mtd(T, params.as_of_date), "sheet"),
        "order_to_cash": lambda: order_to_cash_export(T, params.date_from, params.date_to),
        "sales_contribution": lambda: stage(sales_contribution_export(T, params.date_from, params.date_to), "sheet"),
    }
    wanted = {name: job for name, job in wanted.items() if rt in (name, "all")}
    rows = dict(zip(wanted, at_once(*wanted.values()), strict=True))
    if "gross_profit" in rows:
        mtd = out["gross_profit"] = rows["gross_profit"]
        out["gross_profit_total"] = gross_profit_total(T, params.as_of_date, mtd)
        out["gross_profit_run_rate"] = sales_run_rate(T, params.as_of_date, mtd)
    if "order_to_cash" in rows:
        out["order_to_cash"] = rows["order_to_cash"]
    if "sales_contribution" in rows:
        sheet = out["sales_contribution"] = rows["sales_contribution"]
        out["sales_contribution_total"] = sales_contribution_total(T, params.date_from, params.date_to, sheet)
    return out
