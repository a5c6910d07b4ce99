"""Spark queries against their DuckDB oracle SQL on sf0.001 (a representative
subset; ``tools/oracle_compare.py`` runs every key)."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_compare import rows_of  # noqa: E402

KEYS = ["gross_profit", "order_to_cash", "sales_contribution", "first_payment", "deliveries",
        "export_gp_mtd", "export_o2c", "pivot_gp", "group_o2c_month", "map_payment_state",
        "bundle_display", "component_label", "row_id", "read_records", "preset_last_month"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture(scope="module")
def contract():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    return entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, contract, key):
    q, o = contract
    sdf = q[key](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(o[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)


def test_every_key_has_oracle(contract):
    from ledgerloom.catalog import load_all
    q, o = contract
    own = set(load_all())
    assert own == own & set(o) and own <= set(q) and len(own) >= 106
