"""Group-by, footer, pivot and chart-data queries over report DataFrames.

Measures are report doubles; they are summed as decimals of 9 places, so that group
sums do not depend on partitioning, then shown as double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURE_SUM = "decimal(38,9)"

# Grains accepted in a group-by spec such as 'po_date:month'.
GRAINS = {"day": None, "month": "MM", "year": "year"}


def sum_measure(c: str) -> Column:
    return F.sum(F.col(c).cast(MEASURE_SUM)).cast("double").alias(c)


def group_key(col: str, grain: str | None = None, name: str | None = None) -> Column:
    """Group key: the column itself, or its month/year start for a date grain."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {sorted(GRAINS)}")
    fmt = GRAINS[grain]
    key = F.col(col) if fmt is None else F.trunc(F.col(col), fmt)
    return key.alias(name or (col if fmt is None else f"{col}_{grain}"))


def group_report(df: DataFrame, by: str, measures: list[str], grain: str | None = "day",
                 name: str | None = None, count: str = "row_count") -> DataFrame:
    """One row per group with summed measures and the row count (partial +
    final aggregation; one shuffle of the partial results)."""
    return df.groupBy(group_key(by, grain, name)).agg(
        *[sum_measure(m) for m in measures], F.count(F.lit(1)).alias(count))


def footer(df: DataFrame, measures: list[str], count: str = "row_count") -> DataFrame:
    """List footer totals (a single global aggregate)."""
    return df.agg(*[sum_measure(m) for m in measures], F.count(F.lit(1)).alias(count))


def group_levels(df: DataFrame, keys: list[Column], measures: list[str],
                 sets: list[list[str]] | None = None, count: str = "row_count") -> DataFrame:
    """E6 with E8: groups over any list of keys with the subtotals of each level and the grand total.

    The rows are read and summed once, at the finest grain; the grouping sets (by default every prefix of the
    keys, as a nested list view shows them) are expanded from those sums, so no row is copied once for each level.
    ``grouping_level`` counts the keys that a row stands for (0 = grand total); ``grouping_set`` is Spark's
    grouping id, which tells a subtotal from a group whose key is NULL."""
    fine = df.groupBy(*keys).agg(*[F.sum(F.col(m).cast(MEASURE_SUM)).alias(m) for m in measures], F.count(F.lit(1)).alias(count))
    names = fine.columns[:len(keys)]
    cols = [F.col(c) for c in names]
    if sets is None:
        grouped = fine.rollup(*cols)
    else:
        grouped = fine.groupingSets([[F.col(c) for c in one] for one in sets], *cols)
    gid = F.grouping_id()
    return grouped.agg(*[F.sum(m).cast("double").alias(m) for m in measures], F.sum(count).alias(count),
                       (F.lit(len(names)) - F.bit_count(gid)).cast("int").alias("grouping_level"), gid.cast("int").alias("grouping_set"))


def pivot_columns(df: DataFrame, col: Column, most: int = 1000) -> list:
    """The values that become columns of a wide pivot, in order: one aggregation, whose result must stay small."""
    values = [r[0] for r in df.select(col.alias("v")).distinct().orderBy("v").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} pivot columns; use the long form")
    return values


def pivot_wide(df: DataFrame, row: Column, col: Column, measures: list[str], values: list | None = None, total: bool = True) -> DataFrame:
    """E9/E10 as a table: one row for each row key (and a total row), one column for each value and measure
    (``1998_06_01_qty``), plus ``total_<measure>``.  The values are found first, by ``pivot_columns``, unless given;
    the rows are summed once for each (row, value) before columns are made."""
    values = pivot_columns(df, col) if values is None else values
    fine = df.groupBy(row.alias("_row"), col.alias("_col")).agg(*[F.sum(F.col(m).cast(MEASURE_SUM)).alias(m) for m in measures])
    name = lambda v: "none" if v is None else str(v).replace("-", "_")
    cells = [F.sum(F.when(F.col("_col").eqNullSafe(F.lit(v)), F.col(m))).cast("double").alias(f"{name(v)}_{m}") for v in values for m in measures]
    totals = [F.sum(m).cast("double").alias(f"total_{m}") for m in measures]
    grouped = fine.rollup("_row") if total else fine.groupBy("_row")
    level = [F.grouping_id().cast("int").alias("grouping_level")] if total else []
    key = df.select(row).columns[0]
    return grouped.agg(*cells, *totals, *level).withColumnRenamed("_row", key)


def pivot_long(df: DataFrame, row: Column, col: Column, measures: list[str],
               full_cube: bool = True) -> DataFrame:
    """Pivot table in long form -- every (row, column) cell plus row,
    column and grand totals from one ``cube`` (or ``rollup``) pass;
    ``grouping_level`` is the grouping id (0 = cell, 1 = row total over columns,
    2 = column total, 3 = grand total)."""
    g = df.cube(row, col) if full_cube else df.rollup(row, col)
    return g.agg(*[sum_measure(m) for m in measures],
                 F.count(F.lit(1)).alias("row_count"),
                 F.grouping_id().cast("int").alias("grouping_level"))


def pivot_rows(df: DataFrame, row: Column, measures: list[str]) -> DataFrame:
    """One-dimensional pivot (rows only) with its total row."""
    return df.rollup(row).agg(*[sum_measure(m) for m in measures],
                              F.count(F.lit(1)).alias("row_count"),
                              F.grouping_id().cast("int").alias("grouping_level"))


def chart_data(df: DataFrame, by: Column, measure: str) -> DataFrame:
    """Data behind a bar / line / pie chart: one summed measure per key."""
    return df.groupBy(by).agg(sum_measure(measure))
