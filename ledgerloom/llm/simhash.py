"""Operator 8, SimHash near-dedup: segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits; the bit counts of the segments (0 to 2 each) are a
point whose Manhattan distance to another is never above the fingerprints' Hamming distance.  Pairs within 3
bits thus lie within Manhattan distance 3, and within 1 in one of the two halves of the segments.  The grid
has a cell for each half point; a fingerprint is stored in its own two cells and looks for partners in them
and in the cells one step up (a partner one step down finds it from there).  Candidates pass the Manhattan
bound over all segments, then the exact bit distance.

Only distinct fingerprints are joined (groups of copies meet once), and a cell returns links that connect what
the cell's pairs connect (a spanning forest), not the pairs: pairs are compared in blocks inside the tasks.  A
crowded cell is dealt out as pairs of blocks over many tasks.  Components come from alternating
large-star and small-star rounds over the links, each written to the shared folder.

Edge cases: a null or blank text has fingerprint zero, linked like any other; a null id takes part but is
never the component's name unless all ids of the component are null; repeated rows share a component; an
empty table gives no rows; other columns are kept by the stage and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free, slices, staged

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK = 1024  # fingerprints of a cell that one block holds
EVEN = 0x5555555555555555  # fixed value: the low bit of every two-bit segment
SMALL = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of all k-word shingles, repeats included."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h64 = xxhash.xxh64_intdigest
    if k == 3:
        hashes = [h64(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [h64(b" ".join(words[i:i + k]), SEED) for i in range(len(words) - k + 1)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            col = part.column(part.schema.get_field_index(text)).cast(pa.large_binary())
            fp = np.array([fingerprint(x.as_py() or b"") for x in col], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=[part.schema.names[0], "fp"])


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long."""
    own = df.select(F.col(id_col), F.col(text_col).alias("text"))
    return own.mapInArrow(partial(_prints, text="text"), f"{id_col} {dict(own.dtypes)[id_col]}, fp long")


def _segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts of the two halves' segments, two bits each, as words of 32 bits."""
    counts = (fp & np.uint64(EVEN)) + ((fp >> np.uint64(1)) & np.uint64(EVEN))
    return counts & np.uint64(0xFFFFFFFF), counts >> np.uint64(32)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own cells (home) and the cells one step up, of both halves."""
    for batch in batches:
        for at in range(0, batch.num_rows, SMALL):
            fp = batch.column(0).slice(at, SMALL).to_numpy(zero_copy_only=False).view(np.uint64)
            cell, rows, home = [], [], []
            for half, point in enumerate(_segments(fp)):
                point = point | np.uint64(half << 32)
                cell.append(point), rows.append(fp), home.append(np.ones(len(fp), bool))
                for s in range(0, 32, 2):
                    up = ((point >> np.uint64(s)) & np.uint64(3)) < 2
                    cell.append(point[up] + np.uint64(1 << s)), rows.append(fp[up]), home.append(np.zeros(up.sum(), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ([c.view(np.int64) for c in cell], [r.view(np.int64) for r in rows], home)],
                names=["cell", "fp", "home"])


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the segments of the differences of bit counts."""
    ca = (a & np.uint64(EVEN)) + ((a >> np.uint64(1)) & np.uint64(EVEN))
    cb = (b & np.uint64(EVEN)) + ((b >> np.uint64(1)) & np.uint64(EVEN))
    # per segment |x - y| of values 0..2 is the bit count of the unary codes' difference: x=0:00, 1:01, 2:11
    ua = (ca | (ca >> np.uint64(1))) & np.uint64(EVEN) | (ca & np.uint64(2 * EVEN))
    ub = (cb | (cb >> np.uint64(1))) & np.uint64(EVEN) | (cb & np.uint64(2 * EVEN))
    return np.bitwise_count(ua ^ ub)


def linked(left: np.ndarray, right: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two lists of fingerprints (they may be the same list)."""
    names, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = np.arange(len(names))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out_a, out_b = [], []
    for i, a in enumerate(left):
        near = _manhattan(a, right) <= most
        near[near] = np.bitwise_count(right[near] ^ a) <= most
        for j in np.flatnonzero(near):
            x, y = find(where[i]), find(where[len(left) + j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out_a.append(a), out_b.append(right[j])
    return np.array(out_a, np.uint64), np.array(out_b, np.uint64)


def _cell_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks of one cell: the cell's own fingerprints against those that look into it."""
    fp, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
    a, b = linked(fp[home], fp) if len(fp) > 1 and home.any() else (np.zeros(0, np.uint64),) * 2
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _links_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of small cells that come sorted; what a batch border cuts waits for the rest of its cell."""
    rest = None
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])

    def links(table: pa.Table) -> pa.RecordBatch:
        cell, fp = table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(edge, len(cell)))
        a, b = [], []
        for lo, n in zip(edge[size > 1], size[size > 1], strict=True):
            own = home[lo:lo + n]
            if own.any():
                x, y = linked(fp[lo:lo + n][own], fp[lo:lo + n])
                a.append(x), b.append(y)
        if not a:
            return empty
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        cell = table.column("cell").to_numpy()
        cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
        rest = table.slice(cut)
        yield links(table.slice(0, cut)) if cut else empty
    if rest is not None:
        yield links(rest)


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` (distinct fingerprints within MAX_BITS) that connect whatever all links connect."""
    distinct = prints.select("fp").distinct()
    cells = staged(distinct.mapInArrow(_cells, "cell long, fp long, home boolean"), "simhash-cells")
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("used")).filter("used and n > 1")
    counted = staged(counted.drop("used"), "simhash-counts")
    # cells that one block holds: sorted runs of whole cells
    few = (cells.join(counted.filter(F.col("n") <= BLOCK).select("cell"), "cell", "left_semi")
           .repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_in_order, "a long, b long"))
    # crowded cells: own fingerprints in blocks by hash, each met by every block that looks in; no rows but
    # the blocks' copies and the links are made
    crowded = counted.filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = cells.join(crowded.drop("n"), "cell").withColumn("block", block)
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = others.filter("home").select("cell", F.col("block").alias("x"), F.col("other").cast("long").alias("y"), "fp", "home")
    look = others.select("cell", F.col("other").cast("long").alias("x"), F.col("block").alias("y"), "fp", F.lit(False).alias("home"))
    many = own.unionByName(look).groupBy("cell", "x", "y").applyInPandas(_cell_links, "a long, b long")
    return few.unionByName(many).distinct()


def components(links: DataFrame, name: str = "simhash") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of a link.

    Alternates large-star (a node's larger neighbours point to its smallest) and small-star (smaller or equal
    ones do) until no link changes.  Each round is one or two shuffles of the links; a node with very many
    neighbours costs a grouped minimum (partial sums first) and a join, never a list."""
    low = staged(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    last = None
    while True:
        both = low.unionByName(low.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        low = staged(small, f"{name}-round")
        state = low.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % (1 << 20))).first()
        if state == last:  # the same set of links as a round ago
            break
        last = state
    return low.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        low.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def grouped(prints: DataFrame, id_col: str) -> DataFrame:
    """``fp``, ``component_id`` (the smallest id of its component), ``copies`` (rows with this very
    fingerprint) for every distinct fingerprint."""
    per = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-prints")
    parts = components(near_links(per))
    named = per.join(parts, per["fp"] == parts["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(names, "root").select("fp", "component_id", "copies", "least")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8(docs: DataFrame) -> DataFrame:
    prints = staged(fingerprints(docs, "doc_id", "text"), "simhash")
    groups = grouped(prints, "doc_id").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _with_prints(batches: Iterator[pa.RecordBatch], text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            col = part.column(part.schema.get_field_index(text)).cast(pa.large_binary())
            fp = np.array([fingerprint(x.as_py() or b"") for x in col], np.uint64).view(np.int64)
            yield part.append_column(name, pa.array(fp))


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pipeline stage: one row of each component stays, that with the smallest id (nulls last; of rows with the
    same id the first in the table's order)."""
    fp, row = free(docs, "fp"), free(docs, "row")
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    marked = staged(docs.mapInArrow(partial(_with_prints, text=text_col, name=fp), schema)
                    .withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row).alias("row"))
    stay = grouped(marked.select(F.col(fp).alias("fp"), order.alias("id")), "id")
    stay = stay.select(F.col("component_id.row").alias(row)).distinct()
    return marked.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
