"""Search-view filters over report DataFrames."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lit_date(x):
    return F.lit(x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)))


def date_range(df: DataFrame, col: str, lo=None, hi=None, hi_inclusive: bool = True) -> DataFrame:
    """Inclusive range filter; either bound may be omitted."""
    c = F.col(col)
    if lo is not None:
        df = df.where(c >= _lit_date(lo))
    if hi is not None:
        df = df.where(c <= _lit_date(hi) if hi_inclusive else c < _lit_date(hi))
    return df


# Status presets of the order-to-cash search view.
STATUS_PRESETS = {
    "paid": lambda: F.col("payment_state") != "",
    "not_paid": lambda: F.col("payment_state") == "",
    "delivered": lambda: F.col("delivery_status") == "done",
    "not_delivered": lambda: F.col("delivery_status") != "done",
    "invoiced": lambda: F.col("invoice_status").isin("invoiced", "upselling"),
    "bundle": lambda: F.col("line_type") == "Bundle",
    "standard": lambda: F.col("line_type") == "Standard",
}
# the report column that each status preset reads
STATUS_COLUMNS = {"paid": "payment_state", "not_paid": "payment_state", "delivered": "delivery_status",
                  "not_delivered": "delivery_status", "invoiced": "invoice_status", "bundle": "line_type",
                  "standard": "line_type"}


def status_preset(df: DataFrame, name: str) -> DataFrame:
    if name not in STATUS_PRESETS:
        raise ValueError(f"unknown status preset {name!r}; expected one of {sorted(STATUS_PRESETS)}")
    return df.where(STATUS_PRESETS[name]())


def search(df: DataFrame, field: str, value) -> DataFrame:
    """Case-insensitive 'contains' on text fields, equality on other types (E5)."""
    dtype = dict(df.dtypes)[field]
    if dtype == "string":
        return df.where(F.lower(F.col(field)).contains(str(value).lower()))
    if dtype == "date" and not isinstance(value, dt.date):
        value = dt.date.fromisoformat(str(value))
    return df.where(F.col(field) == F.lit(value))


@dataclass(frozen=True)
class Filters:
    """Search-view filters, all of which must hold: ``search`` pairs (field, value) as in ``search``, and names of
    status presets."""
    search: tuple[tuple[str, object], ...] = ()
    status: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.search or self.status)

    def columns(self) -> set[str]:
        return {f for f, _ in self.search} | {STATUS_COLUMNS[s] for s in self.status}

    def over(self, columns) -> Filters:
        """The filters that read these columns only."""
        return Filters(tuple((f, v) for f, v in self.search if f in columns),
                       tuple(s for s in self.status if STATUS_COLUMNS[s] in columns))

    def apply(self, df: DataFrame) -> DataFrame:
        for field, value in self.search:
            df = search(df, field, value)
        for name in self.status:
            df = status_preset(df, name)
        return df
