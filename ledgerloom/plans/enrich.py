"""Order-line enrichment jobs (G1-G3): cost snapshot, bundle text, component label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonmap import json_value
from ..functions.text import localized, py_float_text

# Fixed value: record description used when a component has neither code nor name.
COMPONENT_DESCRIPTION = "Sale Order Line Bundle"


def cost_snapshot(lines: DataFrame, products: DataFrame, company_id: str | int) -> DataFrame:
    """G1: the line's cost = its product's standard price for ``company_id``
    (a company-keyed JSON map), 0.0 without product or without a price.

    Refresh after product / order-state changes = run it on the changed lines
    only (see ``refresh_cost_snapshot``)."""
    pp = products.select(F.col("id").alias("product_id"),
                         json_value("standard_price", str(company_id)).cast("double").alias("_price"))
    x = lines.select(F.col("id").alias("line_id"), "product_id").join(pp, "product_id", "left")
    cost = F.when(F.col("product_id").isNull(), F.lit(0.0)).otherwise(F.coalesce("_price", F.lit(0.0)))
    return x.select("line_id", "product_id", cost.alias("purchase_price"))


def refresh_cost_snapshot(snapshot: DataFrame, lines: DataFrame, products: DataFrame,
                          company_id: str | int, changed_line_ids: DataFrame) -> DataFrame:
    """Recompute the cost only for ``changed_line_ids`` (column ``line_id``) and
    keep the stored value elsewhere: anti-join + union, no full recompute."""
    changed = changed_line_ids.select("line_id").distinct()
    fresh = cost_snapshot(lines.join(changed.withColumnRenamed("line_id", "id"), "id", "left_semi"),
                          products, company_id)
    kept = snapshot.join(changed, "line_id", "left_anti")
    return kept.unionByName(fresh)


def _component_products(components: DataFrame, products: DataFrame, templates: DataFrame) -> DataFrame:
    pt = templates.select(F.col("id").alias("product_tmpl_id"),
                          localized("name").alias("product_name"))
    pp = (products.select(F.col("id").alias("product_id"), "default_code", "product_tmpl_id",
                          F.lit(True).alias("_exists"))
          .join(pt, "product_tmpl_id", "left"))
    return components.join(pp, "product_id", "left")


def bundle_display(lines: DataFrame, components: DataFrame, products: DataFrame,
                   templates: DataFrame) -> DataFrame:
    """Per order line, its bundle components as '[code] name' (or 'name'),
    joined with ', ' in component id order; '' without components.

    Components whose product record is missing are skipped (the reference
    catches the failed read and continues); a component without product gives ''.
    The list of one line is built in that line's group: it is the output value."""
    c = _component_products(components, products, templates)
    c = c.where(F.col("product_id").isNull() | F.col("_exists").isNotNull())
    code = F.coalesce(F.col("default_code"), F.lit(""))
    name = F.coalesce(F.col("product_name"), F.lit(""))
    item = F.when(code != "", F.concat(F.lit("["), code, F.lit("] "), name)).otherwise(name)
    per_line = (c.select(F.col("line_id"), F.struct(F.col("id").alias("k"), item.alias("v")).alias("e"))
                .groupBy("line_id")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]), ", ")
                     .alias("bundle_display")))
    return (lines.select(F.col("id").alias("line_id"))
            .join(per_line, "line_id", "left")
            .select("line_id", F.coalesce("bundle_display", F.lit("")).alias("bundle_display")))


def component_label(components: DataFrame, products: DataFrame, templates: DataFrame,
                    uoms: DataFrame, description: str = COMPONENT_DESCRIPTION) -> DataFrame:
    """G3: '[code] name xQTY uom', 'name xQTY uom' without code, else
    '<description>, <id>'; quantity printed like a Python float ('2.0')."""
    u = uoms.select(F.col("id").alias("uom_id"), F.col("name").alias("uom_name"))
    c = _component_products(components, products, templates).join(u, "uom_id", "left")
    code = F.coalesce(F.col("default_code"), F.lit(""))
    name = F.coalesce(F.col("product_name"), F.lit(""))
    qty = py_float_text(F.coalesce(F.col("quantity"), F.lit(0.0)))
    uom = F.coalesce(F.col("uom_name"), F.lit(""))
    tail = F.concat(F.lit(" x"), qty, F.lit(" "), uom)
    label = (F.when(code != "", F.concat(F.lit("["), code, F.lit("] "), name, tail))
             .when(name != "", F.concat(name, tail))
             .otherwise(F.concat(F.lit(f"{description}, "), F.col("id").cast("string"))))
    return c.select("id", label.alias("display_name"))
