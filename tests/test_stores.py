"""Stored forms: committed tables, the cost store, daily sums, numbered reports, tables in parts."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import TABLE_QUERIES, load_table_queries
from ledgerloom.operators import grouping as grp
from ledgerloom.plans import contribution, cost_store, exports, gross_profit, registry, state
from ledgerloom.sources import committed, numbered
from ledgerloom.sources.staging import drop_stages, stage
from ledgerloom.sources.tables import load_tables, load_versions


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


@pytest.fixture
def months(spark):
    return lambda *r: spark.createDataFrame([(dt.date(2020, m, 1), k, v) for m, k, v in r], "month date, k int, v string")


# ---- committed tables ----------------------------------------------------------------------------

def test_a_failed_write_leaves_the_table(spark, months, path):
    first = months((1, 1, "a"), (2, 2, "b"))
    committed.commit(first, path, ["month"])
    bad = months((1, 5, "x"), (3, 0, "y")).withColumn("k", F.expr("k div (k - 5)").cast("int"))
    with pytest.raises(Exception):
        committed.commit(bad, path, ["month"], "partitions")
    assert rows(committed.read_committed(spark, path).select(*first.columns)) == rows(first) and committed.current(spark, path).number == 1
    committed.commit(months((3, 3, "c")), path, ["month"], "append")
    assert len(committed.expire(spark, path)) == 1  # the failed version's folder
    assert committed.read_committed(spark, path).count() == 3


def test_partitions_are_replaced_one_by_one(spark, months, path):
    committed.commit(months((1, 1, "a"), (1, 2, "b"), (2, 3, "c")), path, ["month"])
    before = committed.current(spark, path).parts
    after = committed.commit(months((1, 9, "z")), path, ["month"], "partitions").parts
    assert after["month=2020-02-01"] == before["month=2020-02-01"] and after["month=2020-01-01"] != before["month=2020-01-01"]
    assert [(r.k, r.v) for r in committed.read_committed(spark, path).orderBy("k").collect()] == [(3, "c"), (9, "z")]
    committed.commit(months((1, 9, "z")).limit(0), path, ["month"], "partitions", replacing=["month=2020-02-01"])
    assert [r.k for r in committed.read_committed(spark, path).collect()] == [9]
    only = committed.read_committed(spark, path, ["month=2020-01-01", "month=1999-01-01"])
    assert only.count() == 1 and only.schema["month"].dataType.simpleString() == "date"


def test_repeated_and_concurrent_commits(spark, months, path, monkeypatch):
    one = months((1, 1, "a"))
    for _ in range(3):
        committed.commit(one, path, ["month"], "append", commit_id="load-1")
    assert committed.read_committed(spark, path).count() == 1
    stale = committed.current(spark, path)
    committed.commit(one, path, ["month"], "append")
    monkeypatch.setattr(committed, "current", lambda *_: stale)  # a writer that started from the older manifest
    with pytest.raises(committed.CommitConflict):
        committed.commit(one, path, ["month"], "append")
    monkeypatch.undo()
    assert committed.read_committed(spark, path).count() == 2
    with pytest.raises(ValueError):
        committed.commit(one, path, ["k"], "append")
    with pytest.raises(ValueError):
        committed.commit(one, path, mode="merge")
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path + "-none")


def test_null_partitions_and_empty_tables(spark, path):
    df = spark.createDataFrame([(None, 1), ("x y/z", 2)], "p string, k int")
    committed.commit(df, path, ["p"])
    assert rows(committed.read_committed(spark, path).select("p", "k")) == rows(df)
    committed.commit(df.limit(0), path, ["p"])
    assert committed.read_committed(spark, path).count() == 0


# ---- the cost store --------------------------------------------------------------------------------

def test_refresh_rewrites_touched_buckets_only(spark, T1, path):
    cost_store.build(T1, path, "2", 16)
    before = committed.current(spark, path).parts
    old = {r["line_id"]: r for r in cost_store.read(spark, path).collect()}
    assert cost_store.refresh(T1, path, "2", 16) == [] and committed.current(spark, path).number == 1
    some = sorted(old)[:3]
    changed = T1 | {"sale_order_line": T1["sale_order_line"].withColumn("product_id", F.when(F.col("id") == some[0], F.lit(None)).when(
        F.col("id") == some[1], F.col("product_id") + 1).otherwise(F.col("product_id"))).where(F.col("id") != some[2]),
        "product_product": T1["product_product"].withColumn("standard_price", F.lit('{"2": 5}'))}
    touched = cost_store.refresh(changed, path, "2", 16)
    after = committed.current(spark, path).parts
    assert 1 <= len(touched) <= 3 and {p for p in before if before[p] != after.get(p)} == {f"bucket={b}" for b in touched}
    now = {r["line_id"]: r for r in cost_store.read(spark, path).collect()}
    assert some[2] not in now and (now[some[0]]["purchase_price"], now[some[1]]["purchase_price"]) == (0.0, 5.0)
    assert all(now[i] == old[i] for i in old if i not in some)  # a new price alone changes no cost taken earlier


def test_refresh_of_nothing_stored_builds(spark, T1, path):
    assert cost_store.refresh(T1, path, "2", 4) == [0, 1, 2, 3]
    want = TABLE_QUERIES["cost_snapshot"](T1) if load_table_queries() else None
    assert rows(cost_store.read(spark, path).select(*want.columns)) == rows(want)


# ---- daily sums ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sums(spark, T1, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sums") / "s")
    early, before, after = registry._late_orders(T1)
    state.build(early, path)
    state.add_delta(before, after, path, commit_id="late")
    state.add_delta(before, after, path, commit_id="late")  # a repeated delta counts once
    return path


def same(got, want, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].asDict() == pytest.approx(b[k].asDict(), abs=1e-6)


GP, SC = ("category_items", "categ_id", "so_date"), ("category", "categ_id", "so_date")


@pytest.mark.parametrize("window", [(None, None), ("1998-06-15", "1998-06-15"), ("1997-12-20", "1998-02-03"), ("2030-01-01", None)])
def test_reports_from_sums_equal_the_full_ones(T1, sums, window):
    same(state.gross_profit(T1, sums, *window), gross_profit.gross_profit(T1, *window), GP)
    same(state.sales_contribution(T1, sums, *window), contribution.sales_contribution(T1, *window), SC)


def test_reports_from_sums_read_no_lines(T1, sums):
    for df in (state.gross_profit(T1, sums, "1998-06-15", "1998-06-15"), state.sales_contribution(T1, sums, "1998-06-15", "1998-06-15")):
        assert not any("lineitem" in f or "orders" in f for f in df.inputFiles())
        assert "month" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_compaction_keeps_the_sums(spark, T1, sums):
    want = rows(state.read_state(spark, sums, "sales"))
    assert any(len(v) > 1 for v in committed.current(spark, f"{sums}/sales").parts.values())
    assert state.compact(spark, sums)["sales"]
    assert all(len(v) == 1 for name in state.STATES for v in committed.current(spark, f"{sums}/{name}").parts.values())
    assert rows(state.read_state(spark, sums, "sales")) == want
    same(state.sales_contribution(T1, sums), contribution.sales_contribution(T1), SC)


def test_unknown_values_and_taken_back_rows(tiny, path):
    line = dict(id=1, order_id=1, product_id=1, sequence=1, product_uom_qty=Decimal("2"), price_subtotal=None, purchase_price=1.5)
    base = dict(product_category=[dict(id=1, name="C")], product_template=[dict(id=1, name="T", categ_id=1)], product_product=[dict(id=1, product_tmpl_id=1)],
                sale_order=[dict(id=1, name="S1", state="sale", date_order=dt.datetime(1998, 7, 10))], sale_order_line=[line])
    T = tiny(**base)
    state.build(T, path)
    same(state.gross_profit(T, path), gross_profit.gross_profit(T), GP)
    same(state.sales_contribution(T, path), contribution.sales_contribution(T), SC)
    state.add_delta(T, tiny(**(base | dict(sale_order=[], sale_order_line=[]))), path)  # the order is gone
    assert state.gross_profit(T, path).count() == state.sales_contribution(T, path).count() == 0


def test_stored_sums_are_laid_out_by_product_once(spark, T1, sums):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = state.sales_contribution(T1, sums)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    stored = plan.split("Exchange hashpartitioning(product_id#")
    assert len(stored) == 3  # the sums and the products
    assert "hashpartitioning(month#" not in plan


def test_a_delta_follows_its_order_lines_to_the_journal(spark, T1):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        few = state.partials(T1, "margin", few_lines=True)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert plan.index("hashpartitioning(move_id#") < plan.index("hashpartitioning(invoice_line_id#") < plan.index("hashpartitioning(order_line_id#")
        assert rows(few) == rows(state.partials(T1, "margin"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sums_keep_the_places_of_decimals_that_fit(spark):
    wide = spark.sql("SELECT CAST(1.25 AS DECIMAL(18,2)) a, CAST(1.25 AS DECIMAL(38,18)) b, 1.25D c")
    got = [wide.select(state._exact(wide, m)).schema[0].dataType.simpleString() for m in "abc"]
    assert got == ["decimal(18,2)", state.SUM.replace(" ", ""), state.SUM]


# ---- numbered reports ----------------------------------------------------------------------------------

def test_records_come_from_their_files(spark, T1, path):
    report = contribution.sales_contribution(T1, with_id=True)
    numbered.store_numbered(report, path)
    n = report.count()
    every = [r.asDict() for r in committed.read_committed(spark, f"{path}/ids").orderBy("lo").collect()]
    assert len(every) > 2 and every[0]["lo"] == 1 and every[-1]["hi"] == n and all(a["hi"] + 1 == b["lo"] for a, b in zip(every, every[1:]))
    ids = [n, 1, n + 5, 2, n // 2]
    assert len(numbered.files_of(spark, path, ids)) <= 4 < len(every) and numbered.files_of(spark, path, []) == []
    got = numbered.read_stored(spark, path, ids, ["category", "categ_id"], {"categ_id": (T1["product_category"], "name")}).collect()
    want = {r["id"]: r for r in report.collect()}
    assert [r["id"] for r in got] == ids and [r["category"] for r in got] == [want[i]["category"] if i in want else None for i in ids]
    numbered.store_numbered(contribution.sales_contribution(T1, with_id=True), path + "2")
    assert rows(committed.read_committed(spark, f"{path}2/rows")) == rows(committed.read_committed(spark, f"{path}/rows"))


# ---- levels, wide pivots, exports, parts ----------------------------------------------------------------------

def test_levels_are_the_sums_of_their_groups(spark):
    df = spark.createDataFrame([("a", None, 1.25), ("a", 1, 2.5), ("b", 1, 4.0), (None, 2, 8.0), ("a", None, 0.5)], "x string, y int, m double")
    got = {(r.x, r.y, r.grouping_level, r.grouping_set): (r.m, r.row_count) for r in grp.group_levels(df, [F.col("x"), F.col("y")], ["m"]).collect()}
    assert got == {("a", None, 2, 0): (1.75, 2), ("a", 1, 2, 0): (2.5, 1), ("b", 1, 2, 0): (4.0, 1), (None, 2, 2, 0): (8.0, 1),
                   ("a", None, 1, 1): (4.25, 3), ("b", None, 1, 1): (4.0, 1), (None, None, 1, 1): (8.0, 1), (None, None, 0, 3): (16.25, 5)}
    sets = grp.group_levels(df, [F.col("x"), F.col("y")], ["m"], sets=[["y"], []]).collect()
    assert Counter(r.grouping_set for r in sets) == {2: 3, 3: 1}
    plan = grp.group_levels(df, [F.col("x"), F.col("y")], ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # expanded from sums, not from rows


def test_wide_pivot_equals_the_long_one(T1):
    rep = gross_profit.gross_profit(T1, "1998-01-01", "1998-03-31")
    long = {(r["category_items"], str(r["so_month"]), r["grouping_level"]): r["amount"] for r in grp.pivot_long(rep, F.col("category_items"), F.col("so_month"), ["amount"]).collect()}
    wide = grp.pivot_wide(rep, F.col("category_items"), F.col("so_month"), ["amount"])
    assert wide.columns == ["category_items", "1998_01_01_amount", "1998_02_01_amount", "1998_03_01_amount", "total_amount", "grouping_level"]
    for r in wide.collect():
        for m in ("1998-01-01", "1998-02-01", "1998-03-01"):
            assert r[m.replace("-", "_") + "_amount"] == long[r["category_items"], m, 2 * r["grouping_level"]]
        assert r["total_amount"] == long[r["category_items"], "None", 1 + 2 * r["grouping_level"]]
    with pytest.raises(ValueError):
        grp.pivot_columns(rep, F.col("category_items"), most=3)


def test_an_export_reads_each_report_once(spark, T1):
    sheets = exports.export_all(T1, exports.ExportParams("all", dt.date(1998, 6, 15), dt.date(1998, 1, 1), dt.date(1998, 6, 30)))
    for name in ("gross_profit", "gross_profit_total", "gross_profit_run_rate", "sales_contribution", "sales_contribution_total"):
        assert not any("lineitem" in f for f in sheets[name].inputFiles())
    assert rows(sheets["gross_profit_total"]) == rows(exports.gross_profit_total(T1, "1998-06-15"))
    assert rows(sheets["sales_contribution_total"]) == rows(exports.sales_contribution_total(T1, "1998-01-01", "1998-06-30"))
    assert exports.export_name("all", dt.date(1998, 6, 5)) == "export_all_19980605"
    assert exports.export_name("gross_profit", dt.date(1998, 6, 5)) == "export_gross_profit_19980605"


def test_tables_in_parts(spark, path):
    old = spark.createDataFrame([(1, 10, 5, 1, "done")], "id long, sale_line_id long, picking_id long, product_id int, state string")
    new = spark.createDataFrame([(2, 11, 6, 2, "done", 77, "x")], "id long, sale_line_id long, picking_id long, product_id long, state string, sale_bundle_line_id long, other string")
    for k, df in enumerate((old, new, new.withColumn("id", F.lit(3).cast("long")))):
        df.write.parquet(f"{path}/stock_move/load={k}")
    got = load_versions(spark, path, "stock_move", defaults={"sale_bundle_line_id": -1})
    assert sorted((r.id, r.sale_bundle_line_id) for r in got.collect()) == [(1, -1), (2, 77), (3, 77)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # two schemas, three parts
    old.write.parquet(f"{path}/only/stock_move")
    assert "sale_bundle_line_id" not in load_tables(spark, f"{path}/only", tables=("stock_move",), parts=True)["stock_move"].columns
    old.drop("state").write.parquet(f"{path}/bad/stock_move/part")
    with pytest.raises(ValueError):
        load_versions(spark, f"{path}/bad", "stock_move")


def test_stages_are_dropped(spark):
    staged = stage(spark.range(5).toDF("k"), "test")
    folder = staged.inputFiles()[0]
    assert staged.count() == 5 and folder
    drop_stages(spark)
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()
