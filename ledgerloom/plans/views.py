"""Publish the reports as named views (A3) for SQL access."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .common import Tables
from .contribution import sales_contribution
from .gross_profit import gross_profit
from .order_to_cash import order_to_cash

# View names of the three reports.
VIEW_NAMES = {"gross_profit": "gross_profit_report", "order_to_cash": "order_to_cash_report",
              "sales_contribution": "sales_contribution_report"}


def register_reports(spark: SparkSession, T: Tables) -> dict[str, str]:
    """Create or replace one temporary view per report (lazy: each SQL query
    over a view re-plans the whole report, like the reference's views)."""
    builders = {"gross_profit": gross_profit, "order_to_cash": order_to_cash,
                "sales_contribution": sales_contribution}
    for key, fn in builders.items():
        fn(T).createOrReplaceTempView(VIEW_NAMES[key])
    return dict(VIEW_NAMES)
