"""Operator 6, best-fit packing: hierarchical residual packing.

Texts become token ids plus an end id; what is longer than a sequence is cut into full pieces, the first piece
takes the remainder.  Every partition packs its pieces best-fit (longest first, into the fullest bin that still
has room).  Nearly full bins are done; underfull ones move up a tree as items of their own: the bins of several
partitions are packed best-fit again, until one partition is left.  Only pieces' numbers move, not texts.

A packed partition has one bin at most that is half empty or emptier, for two would have been one.  So only such
small bins can still join another, each at most one, and no partition further up meets more of them than it has
branches.  Of the bins with the same room a partition therefore hands up as many as small bins can come on the way to
the root, and its small bin; the rest are done, as nothing left would go into them.  This changes no result and bounds what
a partition holds by ``CAPACITY / 2`` rooms times branches times levels, whatever the input.

Ids are those of the tokenizer's file: texts that hold one of its added tokens are encoded by ``tokenizers`` itself.

Edge cases: a null or empty text is the end id alone; repeated rows are packed as separate documents; a text
of any length is cut whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, span_hashes, staged, utf8

CAPACITY, END_ID = 2048, 0
SLACK = 8  # a bin with at most so many tokens free is done
FAN_IN = 8
SLICE = 1 << 20  # text bytes that are encoded at once

BIN = "group long, fill int, sequence_id long, items array<struct<doc_id:{id},row:long,piece:int,start:long,length:int,ids_crc32:long>>"


class Encoder:
    """Ids of the byte-level BPE.

    Texts are cut before every blank and line feed; the pattern never matches across such a cut when no two
    white-space characters meet and there is no other white space, so equal pieces encode alike and each
    distinct piece of a slice is encoded once.  Other texts are encoded by themselves, those with an added token
    (``<|endoftext|>`` written out) by the tokenizer of the JSON file."""

    def __init__(self, tokens_path: str, pattern: str, file: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(file)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(tokens_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def own_ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ids(text)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        n = len(offsets) - 1
        glued = np.insert(data, offsets[:-1], 10)  # every text starts with a line feed, whose id is dropped
        begins = offsets[:-1] + np.arange(n)
        cuts = (glued == 32) | (glued == 10)
        odd = ODD[glued]
        odd[:-1] |= cuts[:-1] & cuts[1:]
        odd[-1:] |= cuts[-1:]
        two = glued[:-1].astype(np.uint16) << 8 | glued[1:]
        odd[:-1] |= np.isin(two, ODD_PAIRS)
        alone = np.zeros(n, bool)
        alone[np.searchsorted(begins, np.flatnonzero(odd), "right") - 1] = True
        blob = glued.tobytes()
        for token in self.added:
            at = blob.find(token.encode())
            while at >= 0:
                alone[np.searchsorted(begins, at, "right") - 1] = True
                at = blob.find(token.encode(), at + 1)
        start = np.flatnonzero(cuts)
        stop = np.append(start[1:], len(glued))
        doc = np.searchsorted(begins, start, "right") - 1
        usual = ~alone[doc]
        start, stop, doc = start[usual], stop[usual], doc[usual]
        _, where, which = np.unique(span_hashes(glued, start, stop), return_index=True, return_inverse=True)
        sizes = stop[where] - start[where]
        flat = self.ids(b"".join([blob[a:b] for a, b in zip(start[where].tolist(), stop[where].tolist())]).decode())
        edge = np.append(0, np.searchsorted(np.cumsum(self.sizes[flat]), np.cumsum(sizes)) + 1)
        count = np.diff(edge)[which]
        count[start == begins[doc]] -= 1
        skip = (start == begins[doc]).astype(np.int64)
        per_doc = np.bincount(doc, count, minlength=n).astype(np.int64)
        total = np.append(0, np.cumsum(count))
        usual_ids = flat[np.repeat(edge[which] + skip - total[:-1], count) + np.arange(total[-1])]
        if not alone.any():
            return usual_ids, np.append(0, np.cumsum(per_doc))
        ids, at = [], 0
        for i in range(n):
            if alone[i]:
                ids.append(self.own_ids(data[offsets[i]:offsets[i + 1]].tobytes().decode()))
                per_doc[i] = len(ids[-1])
            else:
                ids.append(usual_ids[at:at + per_doc[i]])
                at += per_doc[i]
        return np.concatenate(ids), np.append(0, np.cumsum(per_doc))


# bytes and byte pairs that may belong to white space other than the blank and the line feed
ODD = np.zeros(256, bool)
ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
ODD_PAIRS = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)


@functools.cache
def encoder(tokens_path: str, pattern: str, file: str) -> Encoder:
    return Encoder(tokens_path, pattern, file)


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids)
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def _pieces(batches: Iterator[pa.RecordBatch], tokens_path: str, pattern: str, file: str) -> Iterator[pa.RecordBatch]:
    own = encoder(tokens_path, pattern, file)
    end = np.array([END_ID], "<u4")
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            at, rows = [], []
            ids, edge = own.encode(*utf8(part.column(1)))
            for i, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist())):
                for row in cut(np.append(ids[a:b], end)):
                    at.append(i), rows.append(row)
            piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), part.column(2).take(pa.array(at)), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokens_path: str | None = None, file: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, row (tells repeated rows apart), piece, start, length, ids_crc32.  ``file`` is the
    tokenizer's JSON file, ``tokens_path`` the ranks of the same vocabulary."""
    import public_tokenizers
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    run = partial(_pieces, tokens_path=tokens_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, file=file or public_tokenizers.path("byte_bpe_50k.json"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, row long, piece int, start long, length int, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of places in ``lengths``, longest first, each put into the fullest bin with room."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room: list[int] = []  # the distinct rooms left, sorted
    by_room: dict[int, list[int]] = {}
    for i in order:
        n = lengths[i]
        k = bisect_left(room, n)
        if k < len(room):
            r = room[k]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r], room[k]
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        left = r - n
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return bins


def _pack(group: int, fills: list[int], items: list[list], level: int, levels_left: int) -> list[tuple]:
    """Pack bins (or single pieces) again; (group, fill, sequence_id or None while something may still join, items)."""
    out, open_, same = [], [], {}
    for b in best_fit(fills):
        fill, held = sum(fills[i] for i in b), [x for i in b for x in items[i]]
        done = not levels_left or fill >= CAPACITY - SLACK
        if not done and 2 * fill > CAPACITY:  # a host: one of its room for each small bin that may come
            same[fill] = same.get(fill, 0) + 1
            done = same[fill] > FAN_IN * levels_left
        (out if done else open_).append((fill, held))
    base = (level << 56) + (group << 28)
    return [(group, f, base + i, h) for i, (f, h) in enumerate(out)] + [(group, f, None, h) for f, h in open_]


def _leaf(pdf: pd.DataFrame, levels_left: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True])
    held = [[r] for r in pdf[["doc_id", "row", "piece", "start", "length", "ids_crc32"]].astype(object).where(pdf[["doc_id", "row", "piece", "start", "length", "ids_crc32"]].notna(), None).to_dict("records")]
    return pd.DataFrame(_pack(int(pdf["group"].iloc[0]), pdf["length"].tolist(), held, 0, levels_left),
                        columns=["group", "fill", "sequence_id", "items"]).astype({"sequence_id": "Int64"})


def _merge(pdf: pd.DataFrame, level: int, levels_left: int) -> pd.DataFrame:
    key = [(f, x[0]["row"], x[0]["piece"]) for f, x in zip(pdf["fill"], pdf["items"])]
    pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (-key[i][0], *key[i][1:]))]
    return pd.DataFrame(_pack(int(pdf["group"].iloc[0]), pdf["fill"].tolist(), [list(x) for x in pdf["items"]], level, levels_left),
                        columns=["group", "fill", "sequence_id", "items"]).astype({"sequence_id": "Int64"})


def pack(pieces: DataFrame, leaf_rows: int = 5000) -> DataFrame:
    """``doc_id``, ``row``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    kind = dict(pieces.dtypes)["doc_id"]
    schema = BIN.format(id=kind)
    pieces = staged(pieces, "packing-pieces")
    groups = max(1, math.ceil(pieces.count() / leaf_rows))
    leaf = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    levels, width = 0, groups
    while width > 1:
        levels, width = levels + 1, math.ceil(width / FAN_IN)
    bins = staged(leaf.groupBy("group").applyInPandas(partial(_leaf, levels_left=levels), schema), "packing-bins")
    done = [bins.filter("sequence_id is not null")]
    for level in range(1, levels + 1):
        groups = math.ceil(groups / FAN_IN)
        up = bins.filter("sequence_id is null").withColumn("group", F.col("group") % groups)
        bins = staged(up.groupBy("group").applyInPandas(partial(_merge, level=level, levels_left=levels - level), schema), "packing-bins")
        done.append(bins.filter("sequence_id is not null"))
    whole = functools.reduce(DataFrame.unionByName, done)
    before = F.aggregate(F.slice("items", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return (whole.select("sequence_id", "items", F.posexplode("items").alias("at", "item"))
            .select("item.*", "sequence_id", before.alias("offset")))


def op6(docs: DataFrame) -> DataFrame:
    packed = pack(tokenized(docs, "doc_id", "text"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "row")


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage, the last: the pieces and their places."""
    return op6(docs)
