"""Run headline queries on stored ERP tables and summarise their final (AQE)
physical plans: join strategies, exchanges, windows, scans with pushed filters.

Usage: python tools/plan_report.py <stored_tables_dir> [key ...]
(create the tables with ``ledgerloom.sources.fixtures.materialize``).
"""

from __future__ import annotations

import collections
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.catalog import load_table_queries  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402
from ledgerloom.sources.tables import load_tables  # noqa: E402

KEYS = ["gross_profit", "order_to_cash", "sales_contribution", "first_payment", "export_gp_mtd",
        "deliveries", "export_o2c"]
OPS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "Exchange hashpartitioning", "Exchange rangepartitioning",
       "Exchange SinglePartition", "BroadcastExchange", "ReusedExchange", "HashAggregate",
       "Window", "AQEShuffleRead skewed"]


def main() -> None:
    path = sys.argv[1]
    keys = sys.argv[2:] or KEYS
    spark = build_session("local[8]", 16, extra={"spark.driver.memory": "16g"})
    T = load_tables(spark, path)
    q = load_table_queries()
    for key in keys:
        df = q[key](T)
        qe = df._jdf.queryExecution()
        t0 = time.perf_counter()
        n = qe.toRdd().count()
        dt = time.perf_counter() - t0
        plan = qe.executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        c = collections.Counter()
        for op in OPS:
            c[op] = len(re.findall(re.escape(op), final))
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", final)) - {""})
        print(f"## {key}: {n} rows, {dt:.2f}s")
        print("   " + ", ".join(f"{k}={v}" for k, v in c.items() if v))
        for p in pushed:
            print(f"   pushed: [{p[:140]}]")
    spark.stop()


if __name__ == "__main__":
    main()
