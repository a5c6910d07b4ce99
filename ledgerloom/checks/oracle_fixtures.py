"""DuckDB SQL that derives the same ERP base tables from the driver views.

Written independently of the Spark derivation (``sources/fixtures.py``) so the
differential check covers the derivation as well as the reports.  Each entry is
one CTE; ``fixture_ctes()`` returns them joined for a ``WITH`` clause.
"""

from __future__ import annotations

FIXTURE_CTES: list[tuple[str, str]] = [
    ("product_category", """
        SELECT id, CASE WHEN id = 25 THEN '  ' WHEN id = 24 THEN ' Brand#23 ' ELSE p_brand END AS name
        FROM (SELECT DISTINCT CAST(CAST(substr(p_brand, 7) AS INTEGER) AS BIGINT) AS id, p_brand FROM part)
    """),
    ("product_template", """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 101 = 0 THEN '  '
                    WHEN p_partkey % 31 = 1 THEN '{"id_ID": "only"}'
                    WHEN p_partkey % 3 = 0 THEN '{"en_US": "' || p_name || '", "id_ID": "x"}'
                    ELSE p_name END AS name,
               CASE WHEN p_partkey % 17 = 0 THEN NULL
                    ELSE CAST(CAST(substr(p_brand, 7) AS INTEGER) AS BIGINT) END AS categ_id
        FROM part
    """),
    ("product_product", """
        SELECT p_partkey AS id, p_partkey AS product_tmpl_id,
               CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN ' '
                    ELSE 'P' || CAST(p_partkey AS VARCHAR) END AS default_code,
               CASE WHEN p_partkey % 19 = 0 THEN NULL
                    ELSE '{"10": ' || CAST(CAST(floor(p_retailprice) AS BIGINT) * 9 AS VARCHAR)
                         || ', "2": ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || '}' END
                   AS standard_price
        FROM part
    """),
    ("sale_order", """
        SELECT o_orderkey AS id, 'S' || CAST(o_orderkey AS VARCHAR) AS name,
               CASE o_orderstatus WHEN 'O' THEN 'sale' WHEN 'F' THEN 'done'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'cancel' END END AS state,
               o_orderdate AS date_order,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 3 END AS x_studio_date,
               o_custkey AS partner_id, o_custkey + 1 AS partner_shipping_id,
               o_orderkey % 12 AS user_id,
               CASE WHEN o_orderkey % 6 = 0 THEN ' ' WHEN o_orderkey % 6 = 1 THEN NULL
                    ELSE 'PO-' || CAST(o_orderkey AS VARCHAR) END AS client_order_ref,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 7 DAY END AS commitment_date,
               CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderkey % 4 END AS incoterm,
               CASE WHEN o_orderkey % 8 = 0 THEN 'PORT' END AS incoterm_location,
               CASE WHEN o_orderkey % 9 = 0 THEN ' Franco A ' END AS franco,
               CASE o_orderkey % 4 WHEN 0 THEN 'to invoice' WHEN 1 THEN 'invoiced'
                    WHEN 2 THEN 'upselling' END AS invoice_status
        FROM orders
    """),
    ("sale_order_line", """
        SELECT id, order_id, product_id, sequence,
               CASE WHEN id % 97 = 0 THEN 'line_section' WHEN id % 89 = 0 THEN '' END AS display_type,
               product_uom_qty, price_subtotal AS price_unit, price_subtotal, price_tax,
               CAST(price_subtotal + price_tax AS DECIMAL(18,2)) AS price_total,
               CASE WHEN id % 7 = 0 THEN 0.0 ELSE CAST(product_id AS DOUBLE) END AS purchase_price
        FROM (
            SELECT l_orderkey * 1000 + ROW_NUMBER() OVER (
                       PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                       l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
                       l_shipdate) AS id,
                   l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS sequence,
                   CAST(l_quantity AS DECIMAL(18,2)) AS product_uom_qty,
                   CAST(l_extendedprice AS DECIMAL(18,2)) AS price_subtotal,
                   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))
                        AS DECIMAL(18,2)) AS price_tax
            FROM lineitem)
    """),
    ("fx_move_k", """
        SELECT o_orderkey AS order_id, o_orderdate, 1 AS k FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT o_orderkey, o_orderdate, 2 FROM orders WHERE o_orderkey % 6 = 1
        UNION ALL SELECT o_orderkey, o_orderdate, 5 FROM orders WHERE o_orderkey % 3 = 1
    """),
    ("account_move", """
        SELECT order_id * 10 + k AS id, 'INV/' || CAST(order_id * 10 + k AS VARCHAR) AS name,
               CASE WHEN k = 5 THEN 'entry' WHEN order_id % 23 = 0 THEN 'out_refund'
                    ELSE 'out_invoice' END AS move_type,
               CASE WHEN order_id % 11 = 0 THEN 'draft' ELSE 'posted' END AS state,
               CAST(o_orderdate AS DATE) + 20 AS invoice_date
        FROM fx_move_k
    """),
    ("fx_product_move_line", """
        SELECT l.id * 10 + m.k AS id, m.order_id * 10 + m.k AS move_id, CAST(2 AS BIGINT) AS account_id,
               l.product_uom_qty AS quantity, l.price_subtotal, l.id AS so_line_id
        FROM sale_order_line l JOIN fx_move_k m ON m.order_id = l.order_id AND m.k IN (1, 2)
    """),
    ("account_move_line", """
        SELECT id, move_id, account_id, quantity, price_subtotal FROM fx_product_move_line
        UNION ALL
        SELECT -id, id, CAST(1 AS BIGINT), CAST(NULL AS DECIMAL(18,2)), CAST(NULL AS DECIMAL(18,2))
        FROM account_move
    """),
    ("sale_order_line_invoice_rel", """
        SELECT so_line_id AS order_line_id, id AS invoice_line_id FROM fx_product_move_line
        UNION ALL
        SELECT so_line_id + 1, id FROM fx_product_move_line WHERE so_line_id % 13 = 0
    """),
    ("account_account", """
        SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'asset_receivable'), (CAST(2 AS BIGINT), 'income'))
            AS t(id, account_type)
    """),
    ("account_partial_reconcile", """
        SELECT CASE WHEN order_id % 2 = 0 THEN -(order_id * 10 + k) ELSE -(order_id * 10 + 5) END
                   AS debit_move_id,
               CASE WHEN order_id % 2 = 0 THEN -(order_id * 10 + 5) ELSE -(order_id * 10 + k) END
                   AS credit_move_id
        FROM fx_move_k WHERE k IN (1, 2) AND order_id % 3 = 1
        UNION ALL
        SELECT -(order_id * 10 + 1), -(order_id * 10 + 1) FROM fx_move_k WHERE k = 1 AND order_id % 41 = 0
    """),
    ("account_payment", """
        SELECT o_orderkey * 10 + 5 AS move_id, CAST(o_orderdate AS DATE) + 35 AS date,
               CASE WHEN o_orderkey % 7 = 0 THEN 'draft' ELSE 'posted' END AS state
        FROM orders WHERE o_orderkey % 3 = 1
    """),
    ("fx_picking_k", """
        SELECT o_orderkey AS o, o_orderdate, o_custkey, 1 AS k FROM orders
        UNION ALL SELECT o_orderkey, o_orderdate, o_custkey, 2 FROM orders WHERE o_orderkey % 5 = 1
    """),
    ("stock_picking", """
        SELECT o * 10 + k AS id, 'OUT/' || CAST(o * 10 + k AS VARCHAR) AS name,
               CASE WHEN o % 9 = 0 THEN 'assigned' ELSE 'done' END AS state,
               o_orderdate + INTERVAL 5 DAY AS date_done,
               CASE WHEN o % 3 = 0 THEN NULL ELSE '<p>Handle <b>care</b></p> ' END AS note,
               CASE WHEN o % 5 = 0 THEN NULL ELSE o_custkey END AS partner_id,
               CAST(CASE WHEN o % 37 = 0 THEN 2 WHEN k = 2 THEN 3 ELSE 1 END AS BIGINT) AS picking_type_id
        FROM fx_picking_k
    """),
    ("stock_picking_type", """
        SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'outgoing', CAST(1 AS BIGINT)),
                              (CAST(2 AS BIGINT), 'incoming', CAST(1 AS BIGINT)),
                              (CAST(3 AS BIGINT), 'outgoing', CAST(2 AS BIGINT))) AS t(id, code, warehouse_id)
    """),
    ("stock_warehouse", """
        SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Main'), (CAST(2 AS BIGINT), ' ')) AS t(id, name)
    """),
    ("stock_move", """
        SELECT l.id * 100 + p.k * 10 + c.c AS id, l.id AS sale_line_id, p.o * 10 + p.k AS picking_id,
               l.product_id + CASE WHEN c.c > 0 THEN 1 ELSE 0 END AS product_id,
               CASE WHEN l.id % 53 = 0 THEN 'cancel' ELSE 'done' END AS state,
               CASE WHEN (l.order_id + l.product_id) % 8 = 0 THEN l.id * 10 + c.c END AS sale_bundle_line_id
        FROM sale_order_line l
        JOIN fx_picking_k p ON p.o = l.order_id
        JOIN (VALUES (0), (1), (2)) AS c(c)
          ON c.c = 0 OR (c.c = 1 AND (l.order_id + l.product_id) % 8 = 0)
             OR (c.c = 2 AND (l.order_id + l.product_id) % 16 = 0)
    """),
    ("stock_move_line", """
        SELECT id * 10 + 1 AS id, id AS move_id, CAST(id % 5 + 1 AS DECIMAL(18,2)) AS quantity FROM stock_move
        UNION ALL
        SELECT id * 10 + 2, id, CAST(id % 5 + 2 AS DECIMAL(18,2)) FROM stock_move WHERE id % 3 = 0
    """),
    ("res_partner", """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 43 = 0 THEN ' ' ELSE c_name END AS name,
               CASE WHEN c_custkey % 2 = 0 THEN 'Co ' || c_name END AS commercial_company_name,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Street ' || CAST(c_custkey AS VARCHAR) END AS street,
               CASE WHEN c_custkey % 3 = 0 THEN '' END AS street2,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS city,
               CAST(NULL AS VARCHAR) AS zip
        FROM customer
        UNION ALL
        SELECT s_suppkey + 100000000, s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
    """),
    ("res_users", """
        SELECT s_suppkey AS id, s_suppkey + 100000000 AS partner_id FROM supplier
    """),
    ("account_incoterms", """
        SELECT * FROM (VALUES (CAST(1 AS BIGINT), '{"en_US": "EXW"}'), (CAST(2 AS BIGINT), 'FOB'),
                              (CAST(3 AS BIGINT), '{"fr_FR": "CAF"}')) AS t(id, name)
    """),
    ("sale_order_line_bundle", """
        SELECT l.id * 10 + j.j AS id, l.id AS line_id, l.product_id + j.j - 1 AS product_id,
               CAST(CASE WHEN j.j = 1 THEN 2.0 ELSE 12345678.0 END AS DOUBLE) AS quantity,
               CASE WHEN j.j = 1 THEN CAST(1 AS BIGINT) END AS uom_id
        FROM sale_order_line l JOIN (VALUES (1), (2)) AS j(j) ON TRUE
        WHERE (l.order_id + l.product_id) % 8 = 0
    """),
    ("uom_uom", """
        SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Unit')) AS t(id, name)
    """),
]

BASE_TABLES = [n for n, _ in FIXTURE_CTES if not n.startswith("fx_")]


def fixture_ctes() -> str:
    return ",\n".join(f"{name} AS ({body.strip()})" for name, body in FIXTURE_CTES)
