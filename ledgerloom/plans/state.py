"""Materialised daily sums (A3, B4, B5, D1): mergeable partial sums that the two category reports are read from.

Four committed tables, partitioned by month, hold sums at the grain the reports' joins need -- (product, day) or
(product, month), products and categories being looked up when a report is read, as their names may change:

* ``sales``: quantity and amount by effective order date (Gross Profit's lines);
* ``dates``: valid orders by effective order date (the grid's days);
* ``margin``: revenue, quantity x line cost, quantity without a line cost, by invoice month;
* ``contribution``: sales and costs by plain order date (Sales Contribution's lines).

Every sum is a decimal, with the number of rows and of known values behind it, so sums can be added and
taken back in any order.  Late or changed orders come as a delta: the sums of their rows as they are now, minus
those of their rows as they were.  A delta is one more file in the months it touches; readers add up; ``compact``
rewrites months that have gathered several.  A report reads the months of its window only, never the order lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.dates import month_start
from ..sources.committed import commit, current, read_committed
from ..sources.staging import at_once
from . import contribution as sc
from . import gross_profit as gp
from .common import Tables, valid_orders

SUM = "decimal(38,12)"
# table -> (keys, the day or month that places a row, measures)
STATES: dict[str, tuple[list[str], str, list[str]]] = {
    "sales": (["product_id", "so_date"], "so_date", ["qty", "amount"]),
    "dates": (["so_date"], "so_date", []),
    "margin": (["product_id", "inv_month"], "inv_month", ["revenue", "costed", "uncosted_qty"]),
    "contribution": (["product_id", "so_date"], "so_date", ["sales", "cogs"]),
}


def _rows(T: Tables, name: str, few_lines: bool = False) -> DataFrame:
    """The rows that a table sums; with ``few_lines`` the order lines are few beside the journal."""
    if name == "sales":
        orders = valid_orders(T, date_col="so_date")
        display = F.col("display_type")
        return (T["sale_order_line"].where(display.isNull() | (display == "")).join(orders, "order_id")
                .select("product_id", "so_date", F.col("product_uom_qty").alias("qty"), F.col("price_subtotal").alias("amount")))
    if name == "dates":
        return valid_orders(T, date_col="so_date").select("so_date")
    if name == "margin":
        cost, quantity = F.col("line_cost"), F.col("quantity")
        return gp.invoiced_lines(T, few_lines=few_lines).select("product_id", "inv_month", "revenue", (quantity * cost).alias("costed"),
                                           F.when(cost.isNull(), quantity).alias("uncosted_qty"))
    return sc.dated_lines(T)


def _exact(rows: DataFrame, measure: str) -> Column:
    """A measure as it is summed: decimals that fit keep their own places, which are fewer to shuffle."""
    kind = rows.schema[measure].dataType
    fits = isinstance(kind, DecimalType) and kind.scale <= 12 and kind.precision - kind.scale <= 16
    return F.col(measure) if fits else F.col(measure).cast(SUM)


def partials(T: Tables, name: str, sign: int = 1, few_lines: bool = False) -> DataFrame:
    """Signed partial sums: the keys, ``n`` rows, and each measure's sum and number of known values."""
    keys, day, measures = STATES[name]
    rows = _rows(T, name, few_lines)
    signed = (lambda c: -c) if sign < 0 else (lambda c: c)
    aggs = [signed(F.count(F.lit(1))).alias("n")]
    for m in measures:
        aggs += [signed(F.coalesce(F.sum(_exact(rows, m)), F.lit(0))).cast(SUM).alias(m), signed(F.count(m)).alias(f"n_{m}")]
    return rows.groupBy(*keys).agg(*aggs).withColumn("month", month_start(day))


def _merged(parts: DataFrame, name: str) -> DataFrame:
    """Sums of partial sums; keys whose rows have all been taken back are gone.  A key has one row for each version
    at most, so the rows are laid out by product at once, as the lookups by product need them."""
    keys, _, measures = STATES[name]
    if "product_id" in keys:
        parts = parts.repartition("product_id")
    counts = ["n", *(f"n_{m}" for m in measures)]
    return parts.groupBy("month", *keys).agg(*[F.sum(c).alias(c) for c in counts], *[F.sum(m).cast(SUM).alias(m) for m in measures]).where("n <> 0")


def build(T: Tables, path: str) -> None:
    """Sum everything there is."""
    at_once(*[lambda n=name: commit(partials(T, n), f"{path}/{n}", ["month"]) for name in STATES])


def add_delta(before: Tables | None, after: Tables, path: str, commit_id: str | None = None) -> None:
    """Add rows that changed.  Both table sets hold the changed orders and lines alone (and, for margins, the
    journal and junction rows of those lines, or any set of them that contains these), as they were and as they
    are now; ``before`` is None for new ones."""
    def one(name: str) -> None:
        parts = partials(after, name, few_lines=True)
        if before is not None:
            parts = parts.unionByName(partials(before, name, -1, few_lines=True))
        commit(_merged_delta(parts, name), f"{path}/{name}", ["month"], "append", commit_id=commit_id)
    at_once(*[lambda n=name: one(n) for name in STATES])


def _merged_delta(parts: DataFrame, name: str) -> DataFrame:
    """A delta's sums; keys with nothing left to add are left out."""
    keys, _, measures = STATES[name]
    numbers = ["n", *(c for m in measures for c in (m, f"n_{m}"))]
    some: Column = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in numbers])
    return parts.groupBy(*keys, "month").agg(*[F.sum(c).cast(SUM if c in measures else "long").alias(c) for c in numbers]).where(some).select(
        *keys, *numbers, "month")


def compact(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Rewrite the months that deltas have touched as one version each."""
    done = {}
    for name, (keys, _, measures) in STATES.items():
        months = [p for p, versions in current(spark, f"{path}/{name}").parts.items() if len(versions) > 1]
        if months:
            numbers = ["n", *(c for m in measures for c in (m, f"n_{m}"))]
            whole = _merged(read_committed(spark, f"{path}/{name}", months), name).select(*keys, *numbers, "month")
            commit(whole, f"{path}/{name}", ["month"], "partitions", replacing=months)
        done[name] = months
    return done


def read_state(spark: SparkSession, path: str, name: str, month_from=None, month_to=None) -> DataFrame:
    """The table's sums, measures NULL where no value was known; ``month_*`` (first days) prune partitions."""
    keys, _, measures = STATES[name]
    rows = read_committed(spark, f"{path}/{name}")
    if month_from is not None:
        rows = rows.where(F.col("month") >= F.lit(month_from))
    if month_to is not None:
        rows = rows.where(F.col("month") <= F.lit(month_to))
    return _merged(rows, name).select(*keys, *[F.when(F.col(f"n_{m}") != 0, F.col(m)).alias(m) for m in measures])


def _window(df: DataFrame, lo, hi) -> DataFrame:
    df = df if lo is None else df.where(F.col("so_date") >= F.lit(lo))
    return df if hi is None else df.where(F.col("so_date") <= F.lit(hi))


def _months(lo, hi):
    return (None if lo is None else lo.replace(day=1)), (None if hi is None else hi.replace(day=1))


def gross_profit(T: Tables, path: str, date_from=None, date_to=None) -> DataFrame:
    """The Gross Profit report read from the sums; ``T`` gives products and categories only."""
    spark, lo, hi = T["product_product"].sparkSession, gp._d(date_from), gp._d(date_to)
    dates = _window(read_state(spark, path, "dates", *_months(lo, hi)), lo, hi)
    sales = _window(read_state(spark, path, "sales", *_months(lo, hi)), lo, hi)
    margin = read_state(spark, path, "margin", *gp.margin_months(lo, hi))
    doubles = margin.select("product_id", "inv_month", "revenue", F.col("costed").cast("double").alias("costed"),
                            F.col("uncosted_qty").cast("double").alias("uncosted_qty"))
    return gp.valued_grid(gp.grid_of(T, dates), gp.by_category(T, sales).drop("so_month"), gp.margin_of(T, doubles))


def sales_contribution(T: Tables, path: str, date_from=None, date_to=None) -> DataFrame:
    """The Sales Contribution report read from the sums."""
    spark, lo, hi = T["product_product"].sparkSession, gp._d(date_from), gp._d(date_to)
    sums = _window(read_state(spark, path, "contribution", *_months(lo, hi)), lo, hi)
    return sc.shares_of_day(sc.by_category(T, sums.withColumn("cogs", F.col("cogs").cast("double"))))
