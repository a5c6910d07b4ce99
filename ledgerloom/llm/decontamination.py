"""Operator 13, benchmark decontamination: prefix-filtered set join.

Windows of ``WINDOW`` consecutive item words (a shorter item is one window) are records over their word shingles;
a document contains a window where all of its shingles stand in order.  For full containment the necessary
prefix of a record is one token, its rarest:

1. the shingles of all windows are counted over all documents (map-side sums, then one sum for each shingle);
2. every distinct window keeps its rarest shingle, with its offset in the window (ties: the smaller hash);
3. documents are read again and give, for every place whose shingle is some window's token, the words around
   it; Spark joins them with the windows on the token;
4. length and positional bounds (the window must lie inside the document around that place) and then the words
   themselves decide; hashes only choose candidates.

The hits of a document are merged in start order for ``n_hit``.

Neither pass sends other shingles through Spark: a bitmap of the wanted hashes (1 to 16 MB whatever the
benchmark's size; beyond some 100 000 windows it merely lets more places through to the join) goes to the tasks, everything else is a
join whose sides Spark broadcasts or shuffles by their size.

Edge cases: null, empty and blank texts have no words (null items no windows, null documents no hits); repeated
documents count separately, repeated items under one id once; an item with a null id has windows, which hit
words, and is no entry of the item list; empty tables give no hits, or no rows; other columns are not read.  A
very long text is read in one slice of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, slices, span_hashes, staged, utf8

WINDOW, SHINGLE = 10, 5
SLICE = 2 << 20
BITS = (16, 27)  # least and most binary digits of a place in the bitmap
EACH = 1024  # bits for each wanted hash, until the bitmap is full-grown

# fixed values: bytes of words, after lower-casing A-Z; all bytes of characters beyond ASCII belong to words
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True


class Words:
    """The lower-cased words of a text column: bytes, each word's span and each row's words."""

    def __init__(self, col: pa.Array) -> None:
        offsets, data = utf8(col)
        self.data = LOWER[data]
        inside = INSIDE[self.data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | border[1:-1]
        end[:-1] &= ~inside[1:] | border[1:-1]
        self.lo, self.hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.edge = np.searchsorted(self.lo, offsets)  # the row's first word; one more than rows
        self.count = np.diff(self.edge)
        self.stop = np.repeat(self.edge[1:], self.count)  # the end of each word's row
        self.blob = self.data.tobytes()

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.lo, self.hi)

    def text(self, a: int, b: int) -> str:
        """Words a to b (exclusive), joined by blanks."""
        return b" ".join([self.blob[x:y] for x, y in zip(self.lo[a:b].tolist(), self.hi[a:b].tolist())]).decode()


def shingles(words: Words, size: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``size`` words of one row begin, and their hashes (as signed numbers)."""
    n = len(own) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n) + size <= words.stop[:n])
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mix(h ^ own[at + k]) + np.uint64(k)
    return at, h.view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """The windows of items: their words and the hashes of their shingles."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words = Words(part.column(1))
            own = words.hashes()
            at, texts, tokens = [], [], []
            for i, (a, n) in enumerate(zip(words.edge.tolist(), words.count.tolist())):
                w = min(n, window)
                for lo in range(a, a + n - w + 1) if n else ():
                    at.append(i), texts.append(words.text(lo, lo + w).split(" "))
            item = part.column(0).take(pa.array(at, pa.int64()))
            length = np.array([len(t) for t in texts], np.int64)
            start = np.concatenate([np.arange(a, a + max(n - window, 0) + 1) for a, n in zip(words.edge.tolist(), words.count.tolist()) if n] or [np.zeros(0, np.int64)])
            known = {s: dict(zip(*(x.tolist() for x in shingles(words, s, own)))) for s in {min(size, int(n)) for n in set(length.tolist())}}
            for lo, n in zip(start.tolist(), length.tolist()):
                s = min(size, n)
                tokens.append([known[s][lo + k] for k in range(n - s + 1)])
            yield pa.RecordBatch.from_arrays([item, pa.array(texts, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int64()))],
                                             names=["item_id", "words", "tokens"])


def wanted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - int(math.log2(len(bitmap) * 8)))
    return bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 != 0


def bitmap_of(tokens: DataFrame, count: int) -> np.ndarray:
    """The hashes in column ``token`` as a bitmap of a size bounded by ``BITS``, put together by the executors in pieces of
    4 KB."""
    digits = min(max(math.ceil(math.log2(EACH * max(count, 1))), BITS[0]), BITS[1])
    place = F.shiftrightunsigned(F.col("token"), 64 - digits) + 1  # the functions number bits from 1
    pieces = tokens.select(F.bitmap_bucket_number(place).alias("piece"), F.bitmap_bit_position(place).alias("bit")).groupBy("piece").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((1 << digits) // 8, np.uint8)
    for r in pieces:
        lo = (r["piece"] - 1) * 4096
        out[lo:lo + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _found(words: Words, own: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for size in sizes:
        at, token = shingles(words, size, own)
        some = wanted(bitmap, token)
        yield at[some], token[some]


def _counts(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words = Words(part.column(0))
            token, count = np.unique(np.concatenate([t for _, t in _found(words, words.hashes(), sizes, bitmap.value)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], names=["token", "times"])


PLACES = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))


def _places(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap: Broadcast, window: int) -> Iterator[pa.RecordBatch]:
    """Each document's number of words, and its places of wanted tokens with the words around them."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words = Words(part.column(1))
            held: dict[int, list] = {}
            for at, token in _found(words, words.hashes(), sizes, bitmap.value):
                row = np.searchsorted(words.edge, at, "right") - 1
                for i, p, t in zip(row.tolist(), at.tolist(), token.tolist()):
                    a, b = max(words.edge[i], p - window), min(words.edge[i + 1], p + window)
                    held.setdefault(i, []).append({"token": t, "at": p - int(words.edge[i]), "before": p - int(a), "around": words.text(a, b)})
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(words.count, pa.int64()), pa.array([held.get(i) for i in range(part.num_rows)], PLACES)],
                names=["doc_id", "row", "n_words", "places"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
                  window: int = WINDOW, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """All documents (``row``, ``doc_id``, ``n_words``), and every occurrence of a window in one: ``row``,
    ``start`` (word), ``length``, ``window`` (its words' array)."""
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    windows = staged(bench.mapInArrow(partial(_windows, window=window, size=size),
                                      f"item_id {dict(bench.dtypes)['item_id']}, words array<string>, tokens array<long>").distinct(), "windows")
    distinct = windows.select("words", "tokens").distinct()
    sizes = sorted(r["n"] for r in distinct.select(F.least(F.size("words"), F.lit(size)).alias("n")).distinct().collect())
    tokens = distinct.select(F.explode("tokens").alias("token")).distinct()
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    bitmap = sc.broadcast(bitmap_of(tokens, tokens.count()))
    times = own.select("text").mapInArrow(partial(_counts, sizes=sizes, bitmap=bitmap), "token long, times long") if sizes else tokens.limit(0).selectExpr("token", "token as times")
    times = times.groupBy("token").agg(F.sum("times").alias("times"))
    placed = distinct.select("words", F.posexplode("tokens").alias("offset", "token"))
    rarest = staged(placed.join(times, "token").groupBy("words").agg(  # a window with a shingle that no document has cannot occur
        F.count(F.lit(1)).alias("seen"), F.size("words").alias("length"), F.min(F.struct("times", "token", "offset")).alias("rarest")).filter(
        F.col("seen") == F.col("length") - F.least(F.col("length"), F.lit(size)) + 1).select(
        F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), "length", F.col("words").alias("window")), "window-tokens")
    chosen = rarest.select("token").distinct()
    prefix = sc.broadcast(bitmap_of(chosen, chosen.count()))
    read = staged(own.mapInArrow(partial(_places, sizes=sizes, bitmap=prefix, window=window),
                                 f"doc_id {dict(own.dtypes)['doc_id']}, row long, n_words long, "
                                 "places array<struct<token:long,at:long,before:int,around:string>>"), "document-windows")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    there = F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("length"))
    hits = read.select("row", "n_words", F.inline("places")).join(rarest, "token").filter(inside).filter(there == F.col("window")).select(
        "row", start.alias("start"), "length", "window")
    return read.select("row", "doc_id", "n_words"), staged(hits, "window-hits").join(windows.select(F.col("words").alias("window"), "item_id"), "window")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    read, hits = contamination(docs, benchmark, "doc_id", "text", "item_id", "text")
    end = F.col("start") + F.col("length")
    spans = hits.groupBy("row", "start").agg(F.max(end).alias("end"))  # the longest window of a start covers the others
    reached = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))).groupBy("row").agg(F.sum("fresh").alias("hit"))
    items = hits.filter("item_id is not null").select("row", "item_id").distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("list"))
    return read.join(covered, "row", "left").join(items, "row", "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


# DuckDB: every document word sequence as long as some window, joined with the windows as text
OP13_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[])
              ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item_id FROM places JOIN windows USING (n, words)),
hit_words AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM (SELECT r, s, unnest(range(0, n)) AS k FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS list
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
