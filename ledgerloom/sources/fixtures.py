"""Derive the ERP base tables from the driver's TPC-H-style tables.

Every rule is modular arithmetic on keys (see FIXTURES.md section 2), so the
result is deterministic at every scale factor.  Apart from the per-order line
numbering (one shuffle on ``l_orderkey``, staged when a table built on it is first
asked for) and the distinct brand list, every table is a narrow projection /
``explode`` of one driver table: no joins, so the derivation scales with the
driver tables and adds no wide stages.
"""

from __future__ import annotations

from collections import UserDict
from collections.abc import Callable
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literal import literal_table
from .staging import stage_by

DRIVER_TABLES = ("orders", "lineitem", "part", "customer", "supplier")

# Fixed values of the fixture design (FIXTURES.md section 2).
SALESPERSON_PARTNER_OFFSET = 100_000_000
INCOTERMS = [(1, '{"en_US": "EXW"}'), (2, "FOB"), (3, '{"fr_FR": "CAF"}')]
ACCOUNTS = [(1, "asset_receivable"), (2, "income")]
PICKING_TYPES = [(1, "outgoing", 1), (2, "incoming", 1), (3, "outgoing", 2)]
WAREHOUSES = [(1, "Main"), (2, " ")]
UNITS = [(1, "Unit")]
SHIPPING_NOTE_HTML = "<p>Handle <b>care</b></p> "


MONEY = "decimal(18,2)"  # of the derived quantities and prices


def read_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER_TABLES}


def _mod(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(c, F.lit(n))


def _ids(c: Column | str, n: int, k: int) -> Column:
    """id = c * n + k (move/picking style composite ids)."""
    c = F.col(c) if isinstance(c, str) else c
    return c * F.lit(n) + k


def _days(ts: str, n: int) -> Column:
    return F.date_add(F.to_date(F.col(ts)), n)


def _small(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return literal_table(spark, rows, ddl)


def categories(part: DataFrame) -> DataFrame:
    b = F.substr(F.col("p_brand"), F.lit(7)).cast("int")
    return (part.select(b.cast("long").alias("id"), F.col("p_brand")).distinct()
            .select("id",
                    F.when(F.col("id") == 25, F.lit("  "))
                    .when(F.col("id") == 24, F.lit(" Brand#23 "))
                    .otherwise(F.col("p_brand")).alias("name")))


def templates(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    name = (F.when(_mod(p, 101) == 0, F.lit("  "))
            .when(_mod(p, 31) == 1, F.lit('{"id_ID": "only"}'))
            .when(_mod(p, 3) == 0,
                  F.concat(F.lit('{"en_US": "'), F.col("p_name"), F.lit('", "id_ID": "x"}')))
            .otherwise(F.col("p_name")))
    categ = F.when(_mod(p, 17) == 0, F.lit(None).cast("long")).otherwise(
        F.substr(F.col("p_brand"), F.lit(7)).cast("long"))
    return part.select(p.alias("id"), name.alias("name"), categ.alias("categ_id"))


def products(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    n = F.floor("p_retailprice").cast("long")
    code = (F.when(_mod(p, 13) == 0, F.lit(None).cast("string"))
            .when(_mod(p, 29) == 0, F.lit(" "))
            .otherwise(F.concat(F.lit("P"), p.cast("string"))))
    price = F.when(_mod(p, 19) == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit('{"10": '), (n * 9).cast("string"), F.lit(', "2": '),
                 n.cast("string"), F.lit("}")))
    return part.select(p.alias("id"), p.alias("product_tmpl_id"),
                       code.alias("default_code"), price.alias("standard_price"))


def orders(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    null_s = F.lit(None).cast("string")
    state = (F.when(F.col("o_orderstatus") == "O", F.lit("sale"))
             .when(F.col("o_orderstatus") == "F", F.lit("done"))
             .when(_mod(k, 2) == 0, F.lit("draft"))
             .otherwise(F.lit("cancel")))
    ts_plus = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    return o.select(
        k.alias("id"),
        F.concat(F.lit("S"), k.cast("string")).alias("name"),
        state.alias("state"),
        F.col("o_orderdate").alias("date_order"),
        F.when(_mod(k, 5) == 0, _days("o_orderdate", 3)).alias("x_studio_date"),
        F.col("o_custkey").alias("partner_id"),
        (F.col("o_custkey") + 1).alias("partner_shipping_id"),
        _mod(k, 12).alias("user_id"),
        F.when(_mod(k, 6) == 0, F.lit(" ")).when(_mod(k, 6) == 1, null_s)
        .otherwise(F.concat(F.lit("PO-"), k.cast("string"))).alias("client_order_ref"),
        F.when(_mod(k, 4) == 0, F.lit(None)).otherwise(ts_plus(7)).alias("commitment_date"),
        F.when(_mod(k, 5) == 4, F.lit(None).cast("long")).otherwise(_mod(k, 4)).alias("incoterm"),
        F.when(_mod(k, 8) == 0, F.lit("PORT")).otherwise(null_s).alias("incoterm_location"),
        F.when(_mod(k, 9) == 0, F.lit(" Franco A ")).otherwise(null_s).alias("franco"),
        F.when(_mod(k, 4) == 0, F.lit("to invoice")).when(_mod(k, 4) == 1, F.lit("invoiced"))
        .when(_mod(k, 4) == 2, F.lit("upselling")).otherwise(null_s).alias("invoice_status"),
    )


# rows equal up to here give equal order lines, in whatever order they are numbered
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def numbered_lines(li: DataFrame) -> DataFrame:
    """Whole lineitem rows are unique, (orderkey, linenumber) is not: number
    lines over all columns within their order (one shuffle on l_orderkey)."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.select("l_orderkey", F.row_number().over(w).alias("place"), "l_partkey", "l_linenumber",
                     "l_quantity", "l_extendedprice", "l_tax")


def order_lines(numbered: DataFrame) -> DataFrame:
    """Order lines of ``numbered_lines``: a projection."""
    lid = F.col("l_orderkey") * 1000 + F.col("place")
    sub = F.col("l_extendedprice").cast(MONEY)
    tax = (sub * F.col("l_tax").cast(MONEY)).cast(MONEY)
    return (numbered.select(lid.alias("id"), "*")
            .select(
                "id",
                F.col("l_orderkey").alias("order_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_linenumber").alias("sequence"),
                F.when(_mod("id", 97) == 0, F.lit("line_section"))
                .when(_mod("id", 89) == 0, F.lit(""))
                .otherwise(F.lit(None).cast("string")).alias("display_type"),
                F.col("l_quantity").cast(MONEY).alias("product_uom_qty"),
                sub.alias("price_unit"),
                sub.alias("price_subtotal"),
                tax.alias("price_tax"),
                (sub + tax).cast(MONEY).alias("price_total"),
                F.when(_mod("id", 7) == 0, F.lit(0.0))
                .otherwise(F.col("l_partkey").cast("double")).alias("purchase_price"),
            ))


def _invoice_ks(order_id: Column) -> Column:
    """Invoice moves of an order: k=1 unless o%4=0, k=2 when o%6=1."""
    return F.filter(F.array(F.when(_mod(order_id, 4) != 0, F.lit(1)),
                            F.when(_mod(order_id, 6) == 1, F.lit(2))),
                    lambda x: x.isNotNull())


def moves(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ks = F.filter(F.array(F.when(_mod(k, 4) != 0, F.lit(1)),
                          F.when(_mod(k, 6) == 1, F.lit(2)),
                          F.when(_mod(k, 3) == 1, F.lit(5))), lambda x: x.isNotNull())
    m = o.select(k.alias("order_id"), "o_orderdate", F.explode(ks).alias("k"))
    mid = _ids("order_id", 10, F.col("k"))
    return m.select(
        mid.alias("id"),
        F.concat(F.lit("INV/"), mid.cast("string")).alias("name"),
        F.when(F.col("k") == 5, F.lit("entry"))
        .when(_mod("order_id", 23) == 0, F.lit("out_refund"))
        .otherwise(F.lit("out_invoice")).alias("move_type"),
        F.when(_mod("order_id", 11) == 0, F.lit("draft")).otherwise(F.lit("posted")).alias("state"),
        _days("o_orderdate", 20).alias("invoice_date"),
    )


def _product_move_lines(lines: DataFrame) -> DataFrame:
    pl = lines.select("id", "order_id", "product_uom_qty", "price_subtotal",
                      F.explode(_invoice_ks(F.col("order_id"))).alias("k"))
    return pl.select(
        (F.col("id") * 10 + F.col("k")).alias("id"),
        _ids("order_id", 10, F.col("k")).alias("move_id"),
        F.lit(2).cast("long").alias("account_id"),
        F.col("product_uom_qty").alias("quantity"),
        F.col("price_subtotal"),
        F.col("id").alias("so_line_id"),
    )


def move_lines(lines: DataFrame, mv: DataFrame) -> DataFrame:
    prod = _product_move_lines(lines).drop("so_line_id")
    recv = mv.select((-F.col("id")).alias("id"), F.col("id").alias("move_id"),
                     F.lit(1).cast("long").alias("account_id"),
                     F.lit(None).cast(MONEY).alias("quantity"),
                     F.lit(None).cast(MONEY).alias("price_subtotal"))
    return prod.unionByName(recv)


def invoice_rel(lines: DataFrame) -> DataFrame:
    pl = _product_move_lines(lines)
    extra = F.filter(F.array(F.col("so_line_id"),
                             F.when(_mod("so_line_id", 13) == 0, F.col("so_line_id") + 1)),
                     lambda x: x.isNotNull())
    return pl.select(F.explode(extra).alias("order_line_id"), F.col("id").alias("invoice_line_id"))


def reconciles(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    base = o.select(k.alias("o"), F.explode(_invoice_ks(k)).alias("k"))
    inv = -_ids("o", 10, F.col("k"))
    pay = -_ids("o", 10, 5)
    even = _mod("o", 2) == 0
    pairs = base.where(_mod("o", 3) == 1).select(
        F.when(even, inv).otherwise(pay).alias("debit_move_id"),
        F.when(even, pay).otherwise(inv).alias("credit_move_id"))
    selfs = base.where((F.col("k") == 1) & (_mod("o", 41) == 0)).select(
        inv.alias("debit_move_id"), inv.alias("credit_move_id"))
    return pairs.unionByName(selfs)


def payments(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return o.where(_mod(k, 3) == 1).select(
        _ids(k, 10, 5).alias("move_id"),
        _days("o_orderdate", 35).alias("date"),
        F.when(_mod(k, 7) == 0, F.lit("draft")).otherwise(F.lit("posted")).alias("state"))


def _picking_ks(order_id: Column) -> Column:
    return F.filter(F.array(F.lit(1), F.when(_mod(order_id, 5) == 1, F.lit(2))),
                    lambda x: x.isNotNull())


def pickings(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    p = o.select(k.alias("o"), "o_orderdate", "o_custkey", F.explode(_picking_ks(k)).alias("k"))
    pid = _ids("o", 10, F.col("k"))
    return p.select(
        pid.alias("id"),
        F.concat(F.lit("OUT/"), pid.cast("string")).alias("name"),
        F.when(_mod("o", 9) == 0, F.lit("assigned")).otherwise(F.lit("done")).alias("state"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(5))).alias("date_done"),
        F.when(_mod("o", 3) == 0, F.lit(None).cast("string"))
        .otherwise(F.lit(SHIPPING_NOTE_HTML)).alias("note"),
        F.when(_mod("o", 5) == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("partner_id"),
        F.when(_mod("o", 37) == 0, F.lit(2)).when(F.col("k") == 2, F.lit(3))
        .otherwise(F.lit(1)).cast("long").alias("picking_type_id"),
    )


def stock_moves(lines: DataFrame) -> DataFrame:
    bundle = _mod(F.col("order_id") + F.col("product_id"), 8) == 0
    double = _mod(F.col("order_id") + F.col("product_id"), 16) == 0
    cs = F.filter(F.array(F.lit(0), F.when(bundle, F.lit(1)), F.when(double, F.lit(2))),
                  lambda x: x.isNotNull())
    m = lines.select("id", "order_id", "product_id",
                     F.explode(_picking_ks(F.col("order_id"))).alias("k"))
    m = m.select("*", F.explode(cs).alias("c"))
    return m.select(
        (F.col("id") * 100 + F.col("k") * 10 + F.col("c")).alias("id"),
        F.col("id").alias("sale_line_id"),
        _ids("order_id", 10, F.col("k")).alias("picking_id"),
        (F.col("product_id") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("product_id"),
        F.when(_mod("id", 53) == 0, F.lit("cancel")).otherwise(F.lit("done")).alias("state"),
        F.when(bundle, F.col("id") * 10 + F.col("c")).alias("sale_bundle_line_id"),
    )


def stock_move_lines(sm: DataFrame) -> DataFrame:
    js = F.filter(F.array(F.lit(1), F.when(_mod("id", 3) == 0, F.lit(2))), lambda x: x.isNotNull())
    ml = sm.select("id", F.explode(js).alias("j"))
    return ml.select((F.col("id") * 10 + F.col("j")).alias("id"),
                     F.col("id").alias("move_id"),
                     (_mod("id", 5) + F.col("j")).cast(MONEY).alias("quantity"))


def partners(c: DataFrame, s: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    null_s = F.lit(None).cast("string")
    cust = c.select(
        k.alias("id"),
        F.when(_mod(k, 43) == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
        F.when(_mod(k, 2) == 0, F.concat(F.lit("Co "), F.col("c_name"))).otherwise(null_s)
        .alias("commercial_company_name"),
        F.when(_mod(k, 4) == 0, null_s).otherwise(F.concat(F.lit("Street "), k.cast("string"))).alias("street"),
        F.when(_mod(k, 3) == 0, F.lit("")).otherwise(null_s).alias("street2"),
        F.when(_mod(k, 4) == 0, null_s).otherwise(F.col("c_mktsegment")).alias("city"),
        null_s.alias("zip"),
    )
    sales = s.select(
        (F.col("s_suppkey") + SALESPERSON_PARTNER_OFFSET).alias("id"),
        F.col("s_name").alias("name"),
        null_s.alias("commercial_company_name"), null_s.alias("street"), null_s.alias("street2"),
        null_s.alias("city"), null_s.alias("zip"))
    return cust.unionByName(sales)


def users(s: DataFrame) -> DataFrame:
    return s.select(F.col("s_suppkey").alias("id"),
                    (F.col("s_suppkey") + SALESPERSON_PARTNER_OFFSET).alias("partner_id"))


def bundle_components(lines: DataFrame) -> DataFrame:
    """Two components per bundle line: (part, qty 2.0, unit 1), (part+1, qty 12345678.0, no unit)."""
    b = lines.where(_mod(F.col("order_id") + F.col("product_id"), 8) == 0)
    b = b.select("id", "product_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("j"))
    first = F.col("j") == 1
    return b.select(
        (F.col("id") * 10 + F.col("j")).alias("id"),
        F.col("id").alias("line_id"),
        (F.col("product_id") + F.col("j") - 1).alias("product_id"),
        F.when(first, F.lit(2.0)).otherwise(F.lit(12345678.0)).alias("quantity"),
        F.when(first, F.lit(1)).cast("long").alias("uom_id"),
    )


def _once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``make``, called once, also when several threads ask for its table."""
    lock, made = Lock(), []

    def get() -> DataFrame:
        with lock:
            if not made:
                made.append(make())
        return made[0]
    return get


class Derived(UserDict):
    """Tables by name; a value may be a function that makes the table when it is first asked for."""

    def __getitem__(self, name):
        made = self.data[name]
        if not isinstance(made, DataFrame):
            made = self.data[name] = made()
        return made


def derive(spark: SparkSession, sf_dir: str) -> Derived:
    """All base tables the reports read, as lazy DataFrames keyed by ERP table name.

    Six tables are built on the numbered order lines.  A query that reads one of them stages the numbers first, so
    the numbering window is computed once, not once for each of the tables and scans."""
    d = read_driver(spark, sf_dir)
    mv = moves(d["orders"])
    lines = _once(lambda: order_lines(stage_by(numbered_lines(d["lineitem"]), "order-lines", "l_orderkey")))
    sm = _once(lambda: stock_moves(lines()))
    return Derived({
        "product_category": categories(d["part"]),
        "product_template": templates(d["part"]),
        "product_product": products(d["part"]),
        "sale_order": orders(d["orders"]),
        "sale_order_line": lines,
        "account_move": mv,
        "account_move_line": lambda: move_lines(lines(), mv),
        "sale_order_line_invoice_rel": lambda: invoice_rel(lines()),
        "account_account": _small(spark, ACCOUNTS, "id long, account_type string"),
        "account_partial_reconcile": reconciles(d["orders"]),
        "account_payment": payments(d["orders"]),
        "stock_picking": pickings(d["orders"]),
        "stock_picking_type": _small(spark, PICKING_TYPES, "id long, code string, warehouse_id long"),
        "stock_warehouse": _small(spark, WAREHOUSES, "id long, name string"),
        "stock_move": sm,
        "stock_move_line": lambda: stock_move_lines(sm()),
        "res_partner": partners(d["customer"], d["supplier"]),
        "res_users": users(d["supplier"]),
        "account_incoterms": _small(spark, INCOTERMS, "id long, name string"),
        "sale_order_line_bundle": lambda: bundle_components(lines()),
        "uom_uom": _small(spark, UNITS, "id long, name string"),
    })


def materialize(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    """Derive and store every base table under ``path/<table>`` as parquet, in
    dependency order: order lines and stock moves are written once and the
    tables built on them are derived from the stored copies (the per-order
    numbering window runs once).  Returns the stored tables."""
    d = read_driver(spark, sf_dir)

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    out: dict[str, DataFrame] = {}
    lines = out["sale_order_line"] = store("sale_order_line", order_lines(numbered_lines(d["lineitem"])))
    mv = out["account_move"] = store("account_move", moves(d["orders"]))
    sm = out["stock_move"] = store("stock_move", stock_moves(lines))
    lazy = {
        "product_category": categories(d["part"]),
        "product_template": templates(d["part"]),
        "product_product": products(d["part"]),
        "sale_order": orders(d["orders"]),
        "account_move_line": move_lines(lines, mv),
        "sale_order_line_invoice_rel": invoice_rel(lines),
        "account_account": _small(spark, ACCOUNTS, "id long, account_type string"),
        "account_partial_reconcile": reconciles(d["orders"]),
        "account_payment": payments(d["orders"]),
        "stock_picking": pickings(d["orders"]),
        "stock_picking_type": _small(spark, PICKING_TYPES, "id long, code string, warehouse_id long"),
        "stock_warehouse": _small(spark, WAREHOUSES, "id long, name string"),
        "stock_move_line": stock_move_lines(sm),
        "res_partner": partners(d["customer"], d["supplier"]),
        "res_users": users(d["supplier"]),
        "account_incoterms": _small(spark, INCOTERMS, "id long, name string"),
        "sale_order_line_bundle": bundle_components(lines),
        "uom_uom": _small(spark, UNITS, "id long, name string"),
    }
    # independent tables: submit their jobs concurrently (the scheduler shares the executors)
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=8) as pool:
        stored = dict(zip(lazy, pool.map(lambda kv: store(*kv), lazy.items())))
    out.update(stored)
    return out
