"""Command line: run an export or a report and write it with the table sink.

  python -m ledgerloom export --tables PATH --report all --as-of 1998-06-15 \\
      --date-from 1998-06-01 --date-to 1998-06-30 --out PATH [--format parquet]
  python -m ledgerloom report gross_profit --driver-sf /root/testdata/sf0.01 --out PATH

``--tables`` reads stored ERP tables (``PATH/<table>``); ``--driver-sf`` derives
them from the driver's TPC-H-style tables instead.
"""

from __future__ import annotations

import argparse
import datetime as dt

from .plans import contribution, exports, gross_profit, order_to_cash
from .session import build_session
from .sources.sinks import FORMATS, ordered_for_sink, write_report
from .sources.staging import drop_stages, staged_so_far

REPORTS = {
    "gross_profit": (gross_profit.gross_profit, gross_profit.report_order, [], ["so_month"]),
    "order_to_cash": (lambda T, lo, hi: order_to_cash.order_to_cash(T, lo, hi, keep_keys=True),
                      order_to_cash.report_order, order_to_cash.HIDDEN_KEYS, []),
    "sales_contribution": (contribution.sales_contribution, contribution.sink_order, [], ["so_month"]),
}


def _date(s):
    return dt.date.fromisoformat(s) if s else None


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("command", choices=["export", "report"])
    p.add_argument("name", nargs="?", help="report name for 'report'")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables")
    src.add_argument("--driver-sf")
    p.add_argument("--report", default="all", choices=exports.REPORT_TYPES)
    p.add_argument("--as-of")
    p.add_argument("--date-from")
    p.add_argument("--date-to")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", choices=FORMATS)
    p.add_argument("--dated", action="store_true", help="put the export into a folder named by its kind and day")
    p.add_argument("--master")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    owned = SparkSession.getActiveSession() is None
    spark = build_session(a.master)
    before = staged_so_far()
    if a.tables:
        from .sources.tables import load_tables
        T = load_tables(spark, a.tables, validate=True)
    else:
        from .sources.fixtures import derive
        T = derive(spark, a.driver_sf)

    if a.command == "export":
        params = exports.ExportParams.with_defaults(a.report, as_of_date=_date(a.as_of),
                                                    date_from=_date(a.date_from), date_to=_date(a.date_to))
        folder = f"{a.out}/{exports.export_name(a.report, params.as_of_date)}" if a.dated else a.out
        for sheet, df in exports.export_all(T, params).items():
            write_report(df, f"{folder}/{sheet}", a.format)
            print(f"{sheet}: {folder}/{sheet}")
    else:
        if a.name not in REPORTS:
            p.error(f"report must be one of {sorted(REPORTS)}")
        build, order, hidden, parts = REPORTS[a.name]
        df = ordered_for_sink(build(T, _date(a.date_from), _date(a.date_to)), order(), hidden)
        write_report(df, a.out, a.format, partition_by=parts or None)
        print(f"{a.name}: {a.out}")
    drop_stages(spark, before)
    if owned:
        spark.stop()


if __name__ == "__main__":
    main()
