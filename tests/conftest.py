from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session
    s = build_session("local[*]", 8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="ll-test-wh-")})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ll-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def T1(spark):
    """Derived ERP tables at sf0.001."""
    from ledgerloom.sources.fixtures import derive
    return derive(spark, SF0001)


@pytest.fixture(scope="session")
def T2(spark):
    """Derived ERP tables at sf0.01 (golden values of FIXTURES.md)."""
    from ledgerloom.sources.fixtures import derive
    return derive(spark, SF001)


@pytest.fixture(scope="session")
def schemas(T1):
    return {k: v.schema for k, v in T1.items()}


@pytest.fixture
def tiny(spark, schemas):
    """Build a full table set from a few hand-written rows; other tables empty."""
    def make(**rows):
        out = {}
        for name, schema in schemas.items():
            data = [tuple(r.get(f.name) for f in schema.fields) if isinstance(r, dict) else r
                    for r in rows.get(name, [])]
            out[name] = spark.createDataFrame(data, schema)
        return out
    return make
