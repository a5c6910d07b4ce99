"""Date expressions and the search-view date presets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import as_col


def effective_order_date(so: DataFrame, custom: str = "x_studio_date",
                         base: str = "date_order") -> Column:
    """Custom order date when the optional column exists and is set, else the order date."""
    d = F.to_date(F.col(base))
    if custom in so.columns:
        return F.coalesce(F.to_date(F.col(custom)), d)
    return d


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "MM")


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def _first_of_month(d: dt.date) -> dt.date:
    return d.replace(day=1)


def _prev_month_first(d: dt.date) -> dt.date:
    first = d.replace(day=1)
    return (first - dt.timedelta(days=1)).replace(day=1)


PRESETS = ("today", "this_week", "this_month", "last_month", "this_year")


def preset_bounds(name: str, today) -> tuple[dt.date | None, dt.date | None, bool]:
    """(lower, upper, upper_inclusive) for a date preset, computed on the driver
    from an explicit ``today`` so runs are repeatable.

    this_week is the last 8 days (today-7 .. today); this_month and this_year
    have no upper bound; last_month ends before the first of this month."""
    t = _d(today)
    if name == "today":
        return t, t, True
    if name == "this_week":
        return t - dt.timedelta(days=7), t, True
    if name == "this_month":
        return _first_of_month(t), None, True
    if name == "last_month":
        return _prev_month_first(t), _first_of_month(t), False
    if name == "this_year":
        return t.replace(month=1, day=1), None, True
    raise ValueError(f"unknown date preset {name!r}; expected one of {PRESETS}")


def order_date_window(so: DataFrame, lo=None, hi=None, custom: str | None = "x_studio_date",
                      base: str = "date_order") -> Column | None:
    """A predicate on the *stored* columns equal to ``lo <= effective date <= hi``.

    The effective date is an expression (COALESCE of the custom date and the
    order timestamp's date) that the scan cannot evaluate; this equivalent form
    uses plain comparisons on the two columns, so Catalyst pushes it into the
    parquet scan (row-group / partition pruning).  None when unbounded."""
    if lo is None and hi is None:
        return None

    def day(x):
        return F.lit(_d(x))

    def ts(x):  # from text: no session time zone involved
        return F.lit(f"{_d(x).isoformat()} 00:00:00").cast("timestamp_ntz")

    b = F.col(base)
    base_ok = F.lit(True)
    if lo is not None:
        base_ok = base_ok & (b >= ts(lo))
    if hi is not None:
        base_ok = base_ok & (b < ts(_d(hi) + dt.timedelta(days=1)))
    if not custom or custom not in so.columns:
        return base_ok
    c = F.col(custom)
    custom_ok = c.isNotNull()
    if lo is not None:
        custom_ok = custom_ok & (c >= day(lo))
    if hi is not None:
        custom_ok = custom_ok & (c <= day(hi))
    return custom_ok | (c.isNull() & base_ok)
