"""ledgerloom: order-to-payment reporting as Spark DataFrame jobs.

Entry points:
* ``ledgerloom.sources.tables.load_tables`` / ``load_catalog_tables`` -- the ERP
  base tables (``sources.fixtures.derive`` builds them from TPC-H-style tables);
* ``ledgerloom.plans.gross_profit.gross_profit``,
  ``ledgerloom.plans.order_to_cash.order_to_cash``,
  ``ledgerloom.plans.contribution.sales_contribution`` -- the reports;
* ``ledgerloom.plans.exports.export_all`` and ``ledgerloom.sources.sinks.write_report``;
* ``python -m ledgerloom`` -- the same from the shell;
* ``ledgerloom.catalog.load_all`` -- every registered query by key.
"""

__version__ = "0.1.0"
