"""Dense, ordered row ids without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_cut

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row in partition


def dense_row_id(df: DataFrame, order: list[Column], name: str = "id",
                 num_partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` computed in parallel.

    1. range-partition and sort by ``order`` and checkpoint it, so both passes
       below see the same cut (range bounds come from sampling);
    2. count rows per partition (one row per partition reaches the driver side
       as a tiny DataFrame) and turn the counts into start offsets;
    3. id = offset of the partition + position inside it.

    ``order`` must be a total order (add tie-breakers), as with the window."""
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_mono", F.monotonically_increasing_id())
    ranged = reliable_cut(ranged)
    part = F.shiftright(F.col("_mono"), _LOCAL_BITS)
    counts = ranged.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to order globally
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)
    return (ranged.withColumn("_pid", part)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_start") + local + 1).cast("long"))
            .drop("_pid", "_start", "_mono"))
