"""Registry of the queries exposed to the driver: key -> f(spark, sf_dir) -> DataFrame.

Every query derives the ERP base tables lazily from the driver tables in
``sf_dir`` and runs one operator or report over the whole of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.fixtures import derive

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# the same queries over an already loaded table set: key -> f(tables) -> DataFrame
TABLE_QUERIES: dict[str, Callable[[dict], DataFrame]] = {}

# Fixed parameters of the registered queries: a "today" and a date window
# inside the data range (orders run from 1995-01-01 to 2001-08-01).
TODAY = "1998-06-15"
AS_OF = "1998-06-15"
DATE_FROM = "1998-01-01"
DATE_TO = "1998-06-30"
CHECK_DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to the places that the check compares; the reports themselves do not round."""
    return df.select(*[(F.round(F.col(c), CHECK_DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def query(key: str):
    def deco(fn: Callable[[dict], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(derive(spark, sf_dir)))
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        TABLE_QUERIES[key] = fn
        return fn
    return deco


def load_all() -> dict[str, QueryFn]:
    from .plans import registry  # noqa: F401  (registers on import)
    return dict(QUERIES)


def load_table_queries() -> dict[str, Callable[[dict], DataFrame]]:
    from .plans import registry  # noqa: F401  (registers on import)
    return dict(TABLE_QUERIES)
