"""Status labels of the export tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col
from .text import py_capitalize, py_title_words

# Label maps of the export (state code -> label).
DELIVERY_STATUS_LABELS = {
    "done": "DONE",
    "assigned": "READY",
    "waiting": "WAITING",
    "confirmed": "WAITING",
    "draft": "DRAFT",
    "cancel": "CANCELLED",
}
INVOICE_STATUS_LABELS = {
    "draft": "Draft",
    "posted": "Invoiced",
    "cancel": "Cancelled",
}
PAYMENT_STATE_LABELS = {
    "not_paid": "Not Paid",
    "partial": "Partial",
    "paid": "Paid",
    "in_payment": "In Payment",
}
NOT_PAID = "Not Paid"


def _lookup(c: Column, mapping: dict[str, str], otherwise: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(otherwise)


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def delivery_status_label(c: Column | str) -> Column:
    """Known state -> label, other text upper-cased, empty -> ''."""
    c = as_col(c)
    return F.when(_empty(c), F.lit("")).otherwise(_lookup(c, DELIVERY_STATUS_LABELS, F.upper(c)))


def invoice_status_label(c: Column | str) -> Column:
    """Known state -> label, other text capitalised (Python rules), empty -> ''."""
    c = as_col(c)
    return F.when(_empty(c), F.lit("")).otherwise(_lookup(c, INVOICE_STATUS_LABELS, py_capitalize(c)))


def payment_state_label(c: Column | str) -> Column:
    """Empty -> 'Not Paid', known state -> label, else words title-cased."""
    c = as_col(c)
    return F.when(_empty(c), F.lit(NOT_PAID)).otherwise(
        _lookup(c, PAYMENT_STATE_LABELS, py_title_words(c)))
