"""JSON map helpers (jsonb columns stored as JSON text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col


def json_first_value(c: Column | str) -> Column:
    """First value of a JSON object in jsonb key order (key length, then bytes).

    Replaces the correlated ``(SELECT value FROM jsonb_each_text(x) LIMIT 1)``
    with a per-row expression: parse to a map, sort the entries by
    (octet length of key, key) and take the first value."""
    m = F.from_json(as_col(c), "map<string,string>")
    ranked = F.transform(F.map_entries(m), lambda e: F.struct(
        F.octet_length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.element_at(F.array_sort(ranked), 1)["v"]


def json_value(c: Column | str, key: str) -> Column:
    """Value of ``key`` in a JSON object (any key text, including digits)."""
    return F.from_json(as_col(c), "map<string,string>")[key]


def json_has_duplicate_keys(c: Column | str) -> Column:
    """True when a JSON object text repeats a key.  jsonb cannot hold one (it
    keeps the last value) while ``from_json`` keeps every entry, so such text
    is rejected as bad input instead of silently picking a different value."""
    c = as_col(c)
    keys = F.map_keys(F.from_json(c, "map<string,string>"))
    return c.startswith("{") & (F.size(keys) != F.size(F.array_distinct(keys)))
