"""Base-table scans (A1) and optional-column detection (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ERP tables the reports read.
BASE_TABLES = ("product_category", "product_template", "product_product", "sale_order",
               "sale_order_line", "account_move", "account_move_line", "sale_order_line_invoice_rel",
               "account_account", "account_partial_reconcile", "account_payment", "stock_picking",
               "stock_picking_type", "stock_warehouse", "stock_move", "stock_move_line", "res_partner",
               "res_users", "account_incoterms", "sale_order_line_bundle", "uom_uom")
OPTIONAL_COLUMNS = {"sale_order": ("x_studio_date",), "stock_move": ("sale_bundle_line_id",)}

_M = "decimal(38,18)"  # a number: stored decimals are kept as they are, see ``conform``
# Columns the reports read, per table, with their Spark types (DDL).
SCHEMAS = {
    "product_category": "id bigint, name string",
    "product_template": "id bigint, name string, categ_id bigint",
    "product_product": "id bigint, product_tmpl_id bigint, default_code string, standard_price string",
    "sale_order": ("id bigint, name string, state string, date_order timestamp_ntz, x_studio_date date, "
                   "partner_id bigint, partner_shipping_id bigint, user_id bigint, client_order_ref string, "
                   "commitment_date timestamp_ntz, incoterm bigint, incoterm_location string, franco string, "
                   "invoice_status string"),
    "sale_order_line": (f"id bigint, order_id bigint, product_id bigint, sequence int, display_type string, "
                        f"product_uom_qty {_M}, price_unit {_M}, price_subtotal {_M}, price_tax {_M}, "
                        f"price_total {_M}, purchase_price double"),
    "account_move": "id bigint, name string, move_type string, state string, invoice_date date",
    "account_move_line": f"id bigint, move_id bigint, account_id bigint, quantity {_M}, price_subtotal {_M}",
    "sale_order_line_invoice_rel": "order_line_id bigint, invoice_line_id bigint",
    "account_account": "id bigint, account_type string",
    "account_partial_reconcile": "debit_move_id bigint, credit_move_id bigint",
    "account_payment": "move_id bigint, date date, state string",
    "stock_picking": ("id bigint, name string, state string, date_done timestamp_ntz, note string, "
                      "partner_id bigint, picking_type_id bigint"),
    "stock_picking_type": "id bigint, code string, warehouse_id bigint",
    "stock_warehouse": "id bigint, name string",
    "stock_move": ("id bigint, sale_line_id bigint, picking_id bigint, product_id bigint, state string, "
                   "sale_bundle_line_id bigint"),
    "stock_move_line": f"id bigint, move_id bigint, quantity {_M}",
    "res_partner": ("id bigint, name string, commercial_company_name string, street string, street2 string, "
                    "city string, zip string"),
    "res_users": "id bigint, partner_id bigint",
    "account_incoterms": "id bigint, name string",
    "sale_order_line_bundle": "id bigint, line_id bigint, product_id bigint, quantity double, uom_id bigint",
    "uom_uom": "id bigint, name string",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast the columns the reports read to their declared types and drop the
    rest (a projection: nothing extra is read).  Quantities and prices keep their
    stored decimal type; whole numbers become decimals without places and floating
    ones decimals of 18 places, so no stored digit of money is lost.  Optional
    columns are kept only when the stored table has them; a missing required
    column is an error."""
    from pyspark.sql.types import DecimalType, IntegralType, _parse_datatype_string
    stored = {f.name: f.dataType for f in df.schema.fields}
    schema = _parse_datatype_string(SCHEMAS[table])
    optional = set(OPTIONAL_COLUMNS.get(table, ()))
    cols = []
    for f in schema.fields:
        if f.name in stored:
            own, kind = stored[f.name], f.dataType
            if isinstance(kind, DecimalType):
                kind = own if isinstance(own, DecimalType) else DecimalType(20, 0) if isinstance(own, IntegralType) else kind
            cols.append(F.col(f.name).cast(kind).alias(f.name))
        elif f.name not in optional:
            raise ValueError(f"table {table!r} lacks required column {f.name!r}")
    return df.select(*cols)


# Text columns holding JSON objects (jsonb in the source system).
JSON_COLUMNS = {"product_product": ("standard_price",), "product_template": ("name",),
                "account_incoterms": ("name",)}


def reject_duplicate_json_keys(T: dict[str, DataFrame]) -> None:
    """Raise when a JSON column repeats a key in some row (one distributed
    count per JSON column; only the counts reach the driver)."""
    from ..functions.jsonmap import json_has_duplicate_keys
    for table, cols in JSON_COLUMNS.items():
        if table not in T:
            continue
        for col in cols:
            n = T[table].where(json_has_duplicate_keys(col)).count()
            if n:
                raise ValueError(f"{table}.{col}: {n} JSON value(s) repeat a key")


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                tables=BASE_TABLES, typed: bool = True, validate: bool = False, parts: bool = False) -> dict[str, DataFrame]:
    """Scan stored ERP tables ``{path}/{table}`` and conform them to the
    declared schemas (column pruning and filter pushdown still reach the scan:
    the casts are no-ops on already-typed columns).  ``validate`` rejects JSON
    values with repeated keys.  With ``parts`` a table may lie in sub-folders of
    different schemas (``load_versions``)."""
    out = {}
    for t in tables:
        if parts:
            out[t] = load_versions(spark, path, t, fmt)
            continue
        df = spark.read.format(fmt).load(f"{path}/{t}")
        out[t] = conform(df, t) if typed and t in SCHEMAS else df
    if validate:
        reject_duplicate_json_keys(out)
    return out


def _folders(spark: SparkSession, path: str) -> list[str]:
    """``path`` itself, or its sub-folders when a table was stored in several."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    subs = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
    return subs or [path]


def load_versions(spark: SparkSession, path: str, table: str, fmt: str = "parquet", defaults: dict | None = None) -> DataFrame:
    """A table whose parts were stored at different times, each in a sub-folder of ``path/table`` and with the columns it
    had then.

    Every folder is conformed by its own schema -- optional columns that a part lacks become NULL or their
    value in ``defaults``, numbers get the widest stored decimal -- and folders with the same schema are read by one
    scan, so the plan grows with the number of different schemas, not of parts."""
    from pyspark.sql.types import DecimalType, _parse_datatype_string
    by_schema: dict[str, list[str]] = {}
    for folder in _folders(spark, f"{path}/{table}"):
        by_schema.setdefault(spark.read.format(fmt).load(folder).schema.json(), []).append(folder)
    parts = [conform(spark.read.format(fmt).load(folders[0] if len(folders) == 1 else folders), table) for folders in by_schema.values()]
    optional = OPTIONAL_COLUMNS.get(table, ())
    cols = []
    for f in _parse_datatype_string(SCHEMAS[table]).fields:
        kinds = [p.schema[f.name].dataType for p in parts if f.name in p.columns]
        if not kinds:  # an optional column that no part has: the reports see a table without it
            continue
        kind = kinds[0]
        if isinstance(kind, DecimalType) and len(set(kinds)) > 1:
            scale = max(k.scale for k in kinds)
            kind = DecimalType(min(38, max(k.precision - k.scale for k in kinds) + scale), scale)
        cols.append((f.name, kind))
    out = None
    for p in parts:
        own = p.select(*[(F.col(c) if c in p.columns else F.lit((defaults or {}).get(c) if c in optional else None)).cast(kind).alias(c)
                         for c, kind in cols])
        out = own if out is None else out.unionByName(own)
    return out


# Bucket layout for co-located joins: each pair shares a key and a bucket count,
# so "lines JOIN orders", "journal lines JOIN entries" and "move lines JOIN
# moves" need no shuffle when both sides are stored this way.
BUCKET_KEYS = {"sale_order": "id", "sale_order_line": "order_id",
               "account_move": "id", "account_move_line": "move_id",
               "stock_move": "id", "stock_move_line": "move_id"}


def store_tables(T: dict[str, DataFrame], database: str, buckets: int | None = None,
                 fmt: str = "parquet") -> None:
    """Save the base tables as catalog tables; with ``buckets`` the fact tables
    are bucketed and sorted on their join keys (``BUCKET_KEYS``)."""
    spark = next(iter(T.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in T.items():
        w = df.write.mode("overwrite").format(fmt)
        if buckets and name in BUCKET_KEYS:
            w = w.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        w.saveAsTable(f"{database}.{name}")


def load_catalog_tables(spark: SparkSession, database: str | None = None, tables=BASE_TABLES,
                        typed: bool = True) -> dict[str, DataFrame]:
    """Same as ``load_tables`` for tables registered in the session catalog
    (``spark.table``), e.g. bucketed / partitioned managed tables."""
    out = {}
    for t in tables:
        df = spark.table(f"{database}.{t}" if database else t)
        out[t] = conform(df, t) if typed and t in SCHEMAS else df
    return out


def table_counts(T: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one DataFrame (one job, a union of global aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in T.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
