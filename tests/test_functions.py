"""Expression helpers against Python / PostgreSQL semantics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import labels, text
from ledgerloom.functions.dates import preset_bounds
from ledgerloom.functions.jsonmap import json_first_value, json_value


def one(spark, expr, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_first_nonblank(spark):
    df = spark.createDataFrame([(None, "  ", " b "), ("", None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(text.first_nonblank("a", "b", "c", default="z")).collect()]
    assert got == ["b", "z"]


def test_localized(spark):
    cases = {'{"en_US": "Chair", "id_ID": "x"}': "Chair", '{"id_ID": "only"}': None,
             "plain": "plain", "  ": "  "}
    for value, want in cases.items():
        assert one(spark, text.localized(F.col("s")), value) == want


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.col("s")), "<p>Handle <b>care</b></p> ") == "Handle care"
    assert one(spark, text.strip_html(F.col("s")), None) == ""


def test_python_capitalize_and_title(spark):
    for s in ["to invoice", "UPSELLING", "a", "in_payment"]:
        assert one(spark, text.py_capitalize(F.col("s")), s) == s.capitalize()
    for s in ["not_paid", "draft, posted", "reversed"]:
        assert one(spark, text.py_title_words(F.col("s")), s) == s.replace("_", " ").title()


def test_python_float_text(spark):
    for v in [2.0, 12345678.0, 0.5, 0.0, 3.25]:
        assert one(spark, text.py_float_text(F.col("s")), v, "s double") == "%s" % v


def test_json_first_value_uses_jsonb_key_order(spark):
    # jsonb orders keys by length, then bytes: "2" before "10"
    assert one(spark, json_first_value(F.col("s")), '{"10": 90, "2": 10}') == "10"
    assert one(spark, json_first_value(F.col("s")), '{"b": 1, "a": 2}') == "2"
    assert one(spark, json_first_value(F.col("s")), None) is None
    assert one(spark, json_value(F.col("s"), "2"), '{"10": 90, "2": 10}') == "10"


def _py_delivery(s):
    m = {"done": "DONE", "assigned": "READY", "waiting": "WAITING", "confirmed": "WAITING",
         "draft": "DRAFT", "cancel": "CANCELLED"}
    return m.get(s, s.upper() if s else "")


def _py_invoice(s):
    m = {"draft": "Draft", "posted": "Invoiced", "cancel": "Cancelled"}
    return m.get(s, s.capitalize() if s else "")


def _py_payment(s):
    if not s:
        return "Not Paid"
    m = {"not_paid": "Not Paid", "partial": "Partial", "paid": "Paid", "in_payment": "In Payment"}
    return m.get(s, s.replace("_", " ").title())


def test_status_labels_match_python(spark):
    values = [None, "", "done", "assigned", "waiting", "confirmed", "draft", "cancel", "posted",
              "to invoice", "upselling", "not_paid", "partial", "paid", "in_payment", "reversed",
              "draft, posted", "weird_state"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", labels.delivery_status_label("s").alias("d"),
                     labels.invoice_status_label("s").alias("i"),
                     labels.payment_state_label("s").alias("p")).collect()
    for r in rows:
        assert r["d"] == _py_delivery(r["s"])
        assert r["i"] == _py_invoice(r["s"])
        assert r["p"] == _py_payment(r["s"])


def test_preset_bounds():
    t = dt.date(1998, 6, 15)
    assert preset_bounds("today", t) == (t, t, True)
    assert preset_bounds("this_week", t) == (dt.date(1998, 6, 8), t, True)
    assert preset_bounds("this_month", t) == (dt.date(1998, 6, 1), None, True)
    assert preset_bounds("last_month", t) == (dt.date(1998, 5, 1), dt.date(1998, 6, 1), False)
    assert preset_bounds("this_year", t) == (dt.date(1998, 1, 1), None, True)
    assert preset_bounds("last_month", dt.date(1998, 1, 31))[0] == dt.date(1997, 12, 1)
