"""Operator 9, approximate nearest neighbours: shifted space-filling curves.

Every distinct vector is indexed on several Hilbert curves, each through its own random projection and shift.
The curves' orders are range-partitioned and numbered by Spark; a query meets the rows whose place lies within
``W`` of its own on any curve, block by block, with exact cosines in double precision, and the blocks' best are
merged.

``W`` is the place distance that reaches ``AIM`` of the true neighbours of ``SAMPLE`` queries, found by a block
scan of those queries over all rows; it follows the data, and there is no cap.  The same sample tells how many of
the curves to search: as many as make the fewest comparisons a query (curves times window).  Clustered vectors get
several curves and narrow windows, a small share of an exact scan; vectors without structure get one curve and a window
that comes near to the whole table, never more than it.

The queries that reach into a block of places are dealt into chunks of about ``CHUNK``, each a group of its own
with the block's rows, so that no task holds more than those, however wide the windows.

Equal vectors are indexed once, with their ``k`` + 1 smallest ids: no answer needs more of them.

Edge cases: vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take
no part, nor do rows without id; a repeated id counts once for each distinct vector and is never its own
neighbour; fewer candidates than ``k`` give fewer rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.row_id import dense_row_id
from .common import hash_id, staged

CURVES, DIMS, BITS, SEED = 8, 8, 7, 97
SAMPLE, AIM = 128, 0.97
BLOCK, CHUNK = 8192, 4096  # places of one block, queries of one chunk


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of the grid points ``x`` (rows of small unsigned numbers): the cell's path
    from the root is turned and mirrored bit by bit, then Gray-decoded and interleaved."""
    x = x.T.astype(np.uint64).copy()
    zero = np.uint64(0)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for axis in x:
            mirror = (axis >> np.uint64(b)) & np.uint64(1) != 0
            swap = np.where(mirror, zero, (x[0] ^ axis) & low)
            x[0] ^= np.where(mirror, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1) != 0, np.uint64((1 << b) - 1), zero)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << np.uint64(1) | (axis >> np.uint64(b)) & np.uint64(1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: random projection, random shift, grid, Hilbert order."""
    g = np.random.default_rng([SEED, curve])
    dims = unit.shape[1]
    z = unit @ g.normal(0, 1 / np.sqrt(dims), (dims, DIMS)) * np.sqrt(dims) / 3
    cell = ((np.clip(z, -1, 1) + 1) / 4 + g.random(DIMS) / 2) * (1 << BITS)
    return hilbert(np.minimum(cell.astype(np.int64), (1 << BITS) - 1), BITS).astype(np.int64)


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column(1))
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(unit, c)), batch.column(0)], names=["curve", "key", "rep"])


def _first_ids(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a batch as one row with their smallest ids."""
    for batch in batches:
        pdf = pd.DataFrame({"vec_id": batch.column(0).to_numpy(), "at": np.arange(batch.num_rows),
                            "v": [r.tobytes() for r in _matrix(batch.column(1)) + 0.0]})
        pdf = pdf.sort_values("vec_id").drop_duplicates(["v", "vec_id"])
        pdf = pdf[pdf.groupby("v").cumcount() <= k]
        own = pdf.groupby("v", sort=False).agg(ids=("vec_id", list), at=("at", "first"))
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own["at"], pa.int64())), pa.array(own["ids"].tolist(), pa.list_(pa.int64()))],
                                         names=["v", "ids"])


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (queries @ vectors.T) / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(vectors, axis=1)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine, summed alike wherever the pair is met."""
    return (vectors * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(1)))


def _best(query: np.ndarray, rough: np.ndarray, vectors: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The k + 1 best (score, id) of the candidates; ``rough`` scores choose, exact ones rank."""
    some = np.argpartition(-rough, k + 8)[:k + 9] if len(rough) > k + 9 else np.arange(len(rough))
    if len(rough) > k + 9:  # ties at the cut come along
        some = np.flatnonzero(rough >= rough[some].min() - 1e-12)
    score = exact(query, vectors[some])
    found = [(s, i) for s, j in zip(score.tolist(), some.tolist()) for i in ids[j]]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k + 1]


def _scan(batches: Iterator[pa.RecordBatch], reps: list[int], queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Best candidates in each batch for a bounded list of queries."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v, ids = _matrix(batch.column(1)), [[i] for i in batch.column(0).to_pylist()]
        rough = cosines(queries, v)
        rows = [(q, s, i) for q, x, r in zip(reps, queries, rough, strict=True) for s, i in _best(x, r, v, ids, k)]
        q, s, i = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.float64()), pa.array(i, pa.int64())], names=["q", "score", "id"])


FOUND = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("id", pa.int64())])


def _block(rows: pa.Table, asks: pa.Table, width: int, k: int) -> pa.Table:
    """One block of places: its rows against a chunk of the queries whose windows reach into it."""
    out: list[tuple[int, float, int]] = []
    if rows.num_rows and asks.num_rows:
        rows, asks = rows.sort_by("place"), asks.sort_by("place")
        v, place, ids = _matrix(rows.column("v")), rows.column("place").to_numpy(), rows.column("ids").to_pylist()
        for at in range(0, asks.num_rows, 64):
            some = asks.slice(at, 64)
            x, own = _matrix(some.column("v")), some.column("place").to_numpy()
            rough = cosines(x, v)
            lo, hi = np.searchsorted(place, own - width), np.searchsorted(place, own + width, "right")
            for q, u, r, a, b in zip(some.column("rep").to_pylist(), x, rough, lo, hi, strict=True):
                out += [(q, s, i) for s, i in _best(u, r[a:b], v[a:b], ids[a:b], k)] if b > a else []
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), FOUND.types, strict=True)], schema=FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """``q``, ``best``: the k + 1 best (negated score, id) of each query's finds."""
    pair = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))
    return found.groupBy("q").agg(F.slice(F.sort_array(F.collect_set(pair)), 1, k + 1).alias("best"))


def comparisons(curves: int, width: int, n: int) -> int:
    """Rows that a query meets on so many curves."""
    return curves * min(2 * width + 1, n)


def window(index: DataFrame, places: DataFrame, k: int, n: int) -> tuple[int, int]:
    """How many curves to search, and the place distance that reaches ``AIM`` of the sampled queries' true neighbours
    on them."""
    some = index.filter("asked").orderBy(hash_id("rep", seed=SEED), "rep").limit(SAMPLE).select("rep", "v").collect()
    if not some:
        return 1, 0
    reps, queries = [r["rep"] for r in some], np.array([r["v"] for r in some], float)
    found = index.select("rep", "v").mapInArrow(partial(_scan, reps=reps, queries=queries, k=k), "q long, score double, id long")
    pairs = [(r["q"], b["id"]) for r in top(found, k).collect() for b in r["best"] if b["id"] != r["q"]]
    if not pairs:
        return 1, 0
    wanted = sorted({x for p in pairs for x in p})
    at = {i: np.zeros(CURVES, np.int64) for i in wanted}
    for r in places.filter(F.col("rep").isin(wanted)).select("rep", "curve", "place").collect():
        at[r["rep"]][r["curve"]] = r["place"]
    apart = np.minimum.accumulate([np.abs(at[a] - at[b]) for a, b in pairs], axis=1)
    widths = [int(np.quantile(apart[:, c], AIM, method="higher")) for c in range(CURVES)]
    return min(((c + 1, w) for c, w in enumerate(widths)), key=lambda x: (comparisons(*x, n), x))


def search(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.  ``is_query`` is a condition on the id, named
    ``vec_id``."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(v, x -> x != 0)")
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.filter(F.size("v") == (length["n"] if length else 0))
    kind = dict(own.dtypes)["v"]
    first = own.mapInArrow(partial(_first_ids, k=k), f"v {kind}, ids array<long>")
    merged = first.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    asks = own.filter(is_query).select("vec_id", "v").distinct()
    asked = asks.select("v").distinct().withColumn("asked", F.lit(True))
    index = staged(merged.join(asked, "v", "left").select(F.col("ids")[0].alias("rep"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "ann-index")
    keys = index.select("rep", "v").mapInArrow(_keys, "curve int, key long, rep long")
    places = staged(dense_row_id(keys, [F.col("curve"), F.col("key"), F.col("rep")], "place"), "ann-places").select("curve", "rep", "place")
    curves, width = window(index, places, k, index.count())
    placed = places.filter(F.col("curve") < curves).join(index, "rep").select("place", "rep", "v", "ids", "asked")
    block = lambda c: F.floor(c / BLOCK).cast("long")
    reach = F.sequence(block(F.greatest(F.col("place") - width, F.lit(0))), block(F.col("place") + width))
    reaching = placed.filter("asked").select(F.explode(reach).alias("block"), "place", "rep", "v")
    chunks = reaching.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    asks_of = reaching.join(chunks, "block").withColumn("chunk", F.pmod(hash_id("rep", seed=SEED), F.col("chunks")).cast("int")).drop("chunks")
    rows = placed.select(block(F.col("place")).alias("block"), "place", "v", "ids").join(chunks, "block").select(
        "block", "place", "v", "ids", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows, asks_of = rows.toDF(*rows.columns), asks_of.toDF(*asks_of.columns)  # columns of their own, though both come from ``placed``
    found = rows.groupBy("block", "chunk").cogroup(asks_of.groupBy("block", "chunk")).applyInArrow(
        lambda left, right: _block(left, right, width, k), "q long, score double, id long")
    best = top(found, k)
    answers = asks.join(index.select("v", "rep"), "v").join(best, F.col("rep") == F.col("q")).select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("vec_id")), 1, k)).alias("at", "b"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op9(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, "vec_id", "embedding", F.col("vec_id") % 50 == 0)
