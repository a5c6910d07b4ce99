"""Operator 7, LM scoring: prediction by partial matching over bytes.

A text becomes a stream: lower-cased words, each closed by a blank, then an end symbol.  The trie of contexts of
up to ``ORDER`` bytes is counted over all training documents.  A symbol's probability comes from the longest
context that has seen it; each longer known context is left by an escape (its distinct symbols against its
occurrences, method C), and symbols that a longer context has seen are excluded below it; unseen symbols
share the last escape evenly.  The score is the log10 probability of the whole stream, pretrained: counts are
those of the training documents, whatever the document scored.

Spark does it in blocks.  Each block of texts lists its distinct (ORDER+1)-byte grams and words with their
training counts; these add up to the trie and the word counts; each block then gets back the values of its own
grams and words, no more, and scores its texts.  What moves grows with the blocks' vocabularies; no task holds
the trie.

Words are known by 64-bit hashes in the counts.

Edge cases: a null or blank text is the end symbol alone; a null id counts as the empty text, which is held out;
repeated rows count and score as separate documents; without training documents every symbol has the same
probability; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mix, opened, packets, shrink, span_hashes, staged, utf8, word_bounds

ORDER = 4
START, END = 0xFE, 0xFF  # bytes that no UTF-8 text has
SYMBOLS = 255  # all byte values but START
END_KEY = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
GRAM, WORD_KIND = 0, 1
PART = 1 << 18  # text bytes of a block that are worked on at once
HELD = 1 << 20  # keys that a block's lists gather before they are merged
SMOOTH = 0.1  # fixed value of the base score

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stream(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams (context and symbol, a byte each) of every symbol of every text, and the text of each."""
    n = len(offsets) - 1
    head, tail = np.full((n, ORDER), START, np.uint8), np.tile(np.array([32, END], np.uint8), (n, 1))
    places = np.concatenate([np.repeat(offsets[:-1], ORDER), np.repeat(offsets[1:], 2)])
    order = np.concatenate([np.repeat(np.arange(n) * 2, ORDER), np.repeat(np.arange(n) * 2 + 1, 2)]).argsort(kind="stable")
    glued = np.insert(LOWER[data], places[order], np.concatenate([head.ravel(), tail.ravel()])[order])
    size = np.diff(offsets) + ORDER + 2
    blank = SPACE[glued]
    keep = ~blank
    keep[1:] |= ~blank[:-1] & (glued[:-1] != START)
    glued[blank] = 32
    doc = np.repeat(np.arange(n), size)[keep]
    symbols = glued[keep]
    gram = symbols.astype(np.uint64)
    for j in range(1, ORDER + 1):
        gram[j:] |= symbols[:-j].astype(np.uint64) << np.uint64(8 * j)
    real = symbols != START
    return gram[real].view(np.int64), doc[real]


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every word and of the end of every text, and the text of each."""
    n = len(offsets) - 1
    low = LOWER[data]
    lo, hi = word_bounds(offsets, low)
    key = span_hashes(low, lo, hi).view(np.int64)
    return np.append(key, np.full(n, END_KEY)), np.append(np.searchsorted(offsets, lo, "right") - 1, np.arange(n))


def counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their weights (1 each)."""
    if weight is None:
        key = np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight, first) if len(key) else weight


def _added(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several lists of keys and counts as one."""
    return counted(*(np.concatenate(x) for x in zip(*lists, strict=True)))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams and words of each block, with their counts in its training documents."""
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            gathered: dict[int, list] = {GRAM: [], WORD_KIND: []}
            for part in opened(payload):
                texts = utf8(part.column(1))
                train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for kind, listed in ((GRAM, stream), (WORD_KIND, words)):
                    key, doc = listed(*texts)
                    used = train[doc]
                    del doc
                    gathered[kind].append(counted(key[used]))
                    rest = counted(key[~used])[0]
                    gathered[kind].append((rest, np.zeros(len(rest), np.int64)))
                    if sum(len(k) for k, _ in gathered[kind][1:]) > HELD:
                        gathered[kind] = [_added(gathered[kind])]
            for kind in (GRAM, WORD_KIND):
                key, n = _added(gathered.pop(kind))
                for at in range(0, len(key), 1 << 16):
                    k, c = key[at:at + (1 << 16)], n[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), block)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(c.astype(np.int64))],
                        names=["block", "kind", "key", "n"])
            key = n = k = c = None
            shrink()


def trie(grams: DataFrame) -> DataFrame:
    """log10 probabilities (``key``, ``value``) of all listed grams from their training counts (``key``, ``n``)."""
    # one row for each context of each order: its symbols with counts (at most 255), total and distinct
    nodes, low = {}, grams.filter("n > 0")
    for k in range(ORDER, -1, -1):
        low = low.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        nodes[k] = (low.groupBy(F.shiftright("key", 8).alias("ctx"))
                    .agg(F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(255).alias("s"), "n"))).alias("seen"),
                         F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
    shorter = lambda c, k: F.col(c).bitwiseAND((1 << 8 * k) - 1)
    bounded = lambda df, k: F.broadcast(df) if k <= 1 else df  # noqa: E731  at most 256 contexts of one byte, one of none
    asked = grams.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.collect_list(F.col("key").bitwiseAND(255)).alias("symbols"))
    for k in range(ORDER, -1, -1):
        node = nodes[k].select(F.col("ctx").alias(f"ctx{k}"), F.col("seen").alias(f"seen{k}"), F.col("total").alias(f"total{k}"), F.col("kinds").alias(f"kinds{k}"))
        asked = asked.join(bounded(node, k), shorter("ctx", k) == F.col(f"ctx{k}"), "left").drop(f"ctx{k}")
        if k < ORDER:  # what the longer context has seen is excluded here
            asked = asked.withColumn(f"out{k}", _excluded(k))
    s = F.col("s")
    value = F.lit(None).cast("double")
    escapes = F.lit(0.0)
    for k in range(ORDER, -1, -1):
        total = F.col(f"total{k}") - (F.col(f"out{k}") if k < ORDER else 0)
        kinds = F.col(f"kinds{k}") - (F.coalesce(f"kinds{k + 1}", F.lit(0)) if k < ORDER else 0)
        here = F.try_element_at(f"seen{k}", s)
        value = F.coalesce(value, escapes + F.log10(here / (total + kinds)))
        escapes = escapes + F.when(kinds > 0, F.log10(kinds / (total + kinds))).otherwise(0.0)
    value = F.coalesce(value, escapes - F.log10(F.lit(SYMBOLS) - F.coalesce("kinds0", F.lit(0))))
    return asked.withColumn("s", F.explode("symbols")).select((F.shiftleft("ctx", 8) + s).alias("key"), value.alias("value"))


def _excluded(k: int) -> Column:
    """Occurrences in the order-k context of the symbols that the order-(k+1) context has seen."""
    return F.expr(f"aggregate(coalesce(map_keys(seen{k + 1}), array()), 0L, (sum, x) -> sum + coalesce(try_element_at(seen{k}, x), 0L))")


def _scores(left: pa.Table, right: pa.Table, n_all: int, n_kinds: int, id_type: pa.DataType) -> pa.Table:
    """Score the texts of one block with the values of its grams and words."""
    kind, key, value = (right.column(c).to_numpy() for c in ("kind", "key", "value"))
    model = {}
    for k in (GRAM, WORD_KIND):
        own, v = key[kind == k], value[kind == k]
        order = np.argsort(own, kind="stable")
        model[k] = own[order], v[order]

    def look(k: int, wanted: np.ndarray) -> np.ndarray:
        keys, values = model[k]
        at = np.searchsorted(keys, wanted)
        if len(wanted) and (at.max() >= len(keys) or (keys[at] != wanted).any()):
            raise ValueError("a block lacks values of its own grams or words")
        return values[at]

    out = []
    base = np.log10(n_all + SMOOTH * (n_kinds + 1))
    for payload in left.column("payload"):
        for part in opened(payload):
            texts, n = utf8(part.column(1)), part.num_rows
            key_g, doc_g = stream(*texts)
            score = np.bincount(doc_g, look(GRAM, key_g), minlength=n)
            key_w, doc_w = words(*texts)
            c = look(WORD_KIND, key_w)
            out.append(pa.table({
                "doc_id": part.column(0).cast(id_type), "held_out": pa.array(~part.column(2).to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(np.bincount(doc_w, minlength=n)), "n_known": pa.array(np.bincount(doc_w[c > 0], minlength=n)),
                "train_tokens": pa.array(np.full(n, n_all)), "base_score": pa.array(np.bincount(doc_w, np.log10(c + SMOOTH) - base, minlength=n)),
                "score": pa.array(score)}))
    del kind, key, value, own, v, order, model
    shrink()
    return pa.concat_tables(out) if out else pa.table({})


def score_texts(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """``doc_id``, ``held_out``, token counts, ``base_score`` and ``score``; ``train`` marks the training rows."""
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = packets(own, "ppm-blocks", part_bytes=PART).select("block", "payload")
    rows = staged(blocks.mapInArrow(_vocabulary, "block long, kind byte, key long, n long"), "ppm-vocabulary")
    total = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = staged(total, "ppm-counts")
    seen = total.filter((F.col("kind") == WORD_KIND) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    grams = trie(total.filter(F.col("kind") == GRAM).select("key", "n")).select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value")
    known = total.filter(F.col("kind") == WORD_KIND).select("kind", "key", F.col("n").cast("double").alias("value"))
    values = rows.select("block", "kind", "key").join(grams.unionByName(known), ["kind", "key"])
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        lambda left, right: _scores(left, right, seen["n"], seen["v"], id_type),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score_texts(docs, "doc_id", "text", ~held)
