import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, sharding


def held(df):
    shards = defaultdict(list)
    for r in df.collect():
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    return shards


def test_shards_are_even_gapless_and_carry_the_texts(documents, texts):
    out = sharding.op5(documents)
    rows = out.collect()
    sizes = [len(s) for s in held(out).values()]
    assert len(rows) == len(texts) and max(sizes) - min(sizes) <= 1
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert r["size"] == len(b) + 8 and r["text_crc32"] == zlib.crc32(b)
    assert rows == out.collect()


def test_shuffle_order_is_not_the_input_order(documents):
    order = [r["doc_id"] for r in sharding.op5(documents).orderBy("shard", "slot").collect()]
    assert order != sorted(order)
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_small_buckets_give_one_order_and_files_hold_it(spark, documents, tmp_path):
    out = sharding.external_shuffle(documents, "doc_id", "text", 4, bucket_bytes=20_000)
    sizes = [len(s) for s in held(out).values()]
    assert max(sizes) - min(sizes) <= 1
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and {"shard", "slot", "text"} <= set(back.columns)


def test_shard_edges(edge_docs, no_docs):
    assert no_docs.count() == sharding.op5(no_docs).count() == 0
    rows = sharding.external_shuffle(edge_docs, "doc_id", "text", 24)
    assert rows.select("record.*").columns == edge_docs.columns
    held(rows)
    got = Counter((r["doc_id"], r["size"]) for r in sharding.op5(edge_docs).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8) for r in edge_docs.select("doc_id", "text").collect())


def test_equal_rows_fill_all_buckets(spark, make_docs, tmp_path):
    same = make_docs(["one text"] * 20000, [None] * 20000)
    same.write.parquet(str(tmp_path / "d"))
    for df in (same, spark.read.parquet(str(tmp_path / "d"))):
        sizes = [r["count"] for r in sharding.scatter(df, "doc_id", "text", 10, 17).groupBy("bucket").count().collect()]
        assert len(sizes) == 10 and max(sizes) < 1.2 * min(sizes)
        out = sharding.external_shuffle(df, "doc_id", "text", 7, bucket_bytes=32_000)
        rows = sorted(len(x) for x in held(out).values())
        assert sum(rows) == 20000 and rows[-1] - rows[0] <= 1


def test_order_depends_on_the_files_alone(spark, documents, tmp_path):
    documents.repartition(6).write.parquet(str(tmp_path / "d"))

    def read():
        return spark.read.parquet(str(tmp_path / "d"))

    def result():
        return read().rdd.getNumPartitions(), {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.op5(read()).collect()}
    parts, one = result()
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        fewer, again = result()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert fewer < parts and again == one


def shuffled_places(seed, partition, sizes):
    """The inside-out Fisher-Yates shuffle of arrays of these sizes, from one Mersenne twister of the seed."""
    r, out = random.Random(seed + partition << 32), []
    for n in sizes:
        places = list(range(n))
        for i in range(n):
            if i + 1 & i == 0:
                j = (i + 1) * r.getrandbits(31) >> 31
            else:
                while True:
                    bits = r.getrandbits(31)
                    j = bits % (i + 1)
                    if bits - j + i < 1 << 31:
                        break
            if j != i:
                places[i] = places[j]
            places[j] = i
        out.append(places)
    return out


def test_slots_are_those_of_a_brute_force_fisher_yates(spark, documents):
    docs, buckets = documents.select("doc_id", "text"), 6
    volume = sum(len(r["text"].encode()) + 8 for r in docs.collect())
    size = volume // buckets + 1
    scattered = defaultdict(list)
    for r in sharding.scatter(docs, "doc_id", "text", buckets, 17).collect():
        scattered[r["bucket"]].append(r["row"]["id"])
    target = {r["b"]: r["p"] for r in spark.createDataFrame([(b,) for b in scattered], "b long").select("b", F.pmod(F.hash("b"), F.lit(buckets)).alias("p")).collect()}
    start, before = {}, 0
    for b in sorted(scattered):
        start[b] = before
        before += len(scattered[b])
    place = {}
    for p in set(target.values()):
        mine = sorted(b for b in scattered if target[b] == p)
        for b, order in zip(mine, shuffled_places(17, p, [len(scattered[b]) for b in mine]), strict=True):
            ids = sorted(scattered[b])
            place.update({ids[x]: start[b] + k for k, x in enumerate(order)})
    n, shards = len(place), 5
    want = {d: (x * shards // n, x - -(-(x * shards // n) * n // shards)) for d, x in place.items()}
    got = sharding.external_shuffle(docs, "doc_id", "text", shards, bucket_bytes=size)
    assert {r["record"]["doc_id"]: (r["shard"], r["slot"]) for r in got.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 6)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(0, 900))
def test_subset_counts_reach_the_best_sum_of_small_cases(pairs, budget):
    lengths, counts = (np.array(x) for x in zip(*pairs))
    take = mixing.subset_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for n, c in pairs:
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert abs((lengths * take).sum() - budget) == min(abs(s - budget) for s in sums)


def test_subset_counts_fill_a_budget():
    lengths, counts = np.arange(1, 400), np.full(399, 3)
    for budget in (1, 77, 5000, 100_003):
        assert (lengths * mixing.subset_counts(lengths, counts, budget)).sum() == budget


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / weight > most * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * w[s] / weight for s in free}}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(documents):
    rows = mixing.op1(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    want = expected_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    # a source of ten documents cannot meet every target; nothing comes nearer than its subsets do
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 8 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.op1(documents).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mix_edges(edge_docs, no_docs):
    assert mixing.op1(no_docs).count() == 0
    rows = mixing.op1(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {0}
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in rows)
    stage = mixing.stage(edge_docs)
    assert stage.columns == edge_docs.columns
    copies = {(r["doc_id"], r["taken"]) for r in rows}
    assert stage.filter("doc_id = 4").count() == next(t for d, t in copies if d == 4) / 30000


def test_a_hot_length_group_is_cut_by_hash_cells(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
                                    F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    rows = mixing.op1(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(r[1] - r[2]) <= 3 for r in rows)
