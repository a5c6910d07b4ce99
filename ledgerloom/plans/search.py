"""The search view's filters over a whole report (E3, E5), applied where the report's tables hold them.

Order to cash turns filters on orders, pickings and invoices into key scopes (``order_to_cash.key_scope``); the
two category reports turn a day or month into the window of their builders.  What cannot be routed is
applied to the finished rows; every filter is, so routing never decides a row by itself."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators.filters import Filters
from .common import Tables
from .contribution import sales_contribution
from .gross_profit import gross_profit
from .order_to_cash import order_to_cash

REPORTS = {"gp": gross_profit, "o2c": order_to_cash, "sc": sales_contribution}


def _day(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def window_of(filters: Filters) -> tuple[dt.date | None, dt.date | None]:
    """The days that filters on a category report's day or month leave."""
    lo, hi = None, None
    for field, value in filters.search:
        if field in ("so_date", "so_month"):
            first = _day(value)
            last = first if field == "so_date" else (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
            lo, hi = max(lo or first, first), min(hi or last, last)
    return lo, hi


def filtered_report(T: Tables, report: str, filters: Filters, date_from=None, date_to=None, **options) -> DataFrame:
    """The rows of a report (``gp``, ``o2c``, ``sc``) that pass the filters, within an optional window."""
    if report == "o2c":
        return order_to_cash(T, date_from, date_to, filters=filters, **options)
    lo, hi = window_of(filters)
    lo = max((d for d in (lo, date_from and _day(date_from)) if d), default=None)
    hi = min((d for d in (hi, date_to and _day(date_to)) if d), default=None)
    return filters.apply(REPORTS[report](T, lo, hi, **options))
