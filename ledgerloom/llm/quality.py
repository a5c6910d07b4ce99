"""Operator 4, quality rules: line sequence labelling with a linear-chain conditional random field.

Every line of a text gets a feature vector; Viterbi decoding marks it content or boilerplate; the share of
words in content lines decides whether the document stays.  Fixed base rules (too few words, too many words in
repeated 8-word windows) reject first.

The field is trained here, by gradient ascent on the sequence likelihood, on at most ``TRAIN_DOCS`` labelled
documents and ``TRAIN_LINES`` lines of each; all documents are labelled whole.  An id and label count once, with
one text, however often their rows are repeated.  Without labels of both kinds only the base rules decide.

Edge cases: a null or blank text has no words and fails the base rules; a null id stays null; repeated rows
are judged alike; an empty table gives no rows; other columns are kept by the stage and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_id, mix, slices, span_hashes, utf8, word_bounds

TRAIN_DOCS, TRAIN_LINES = 1200, 40
WINDOW, MIN_WORDS, MOST_REPEATED, MIN_CONTENT = 8, 20, 30, 0.5
CONTENT, BOILERPLATE = 1, 0

SYMBOL, UPPER, DIGIT, LETTER, MARK, END, POINT, PIPE = (np.zeros(256, bool) for _ in range(8))
SYMBOL[list(b"#*$%&|<>")] = True
PIPE[list(b"|")] = True
UPPER[65:91] = DIGIT[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MARK[list(b"!?=_{}[]\\^~@+")] = True
END[list(b".!?:;\"'")] = True
POINT[:128] = POINT[192:] = True  # the first byte of a code point
N_FEATURES = 12


class Counts:
    """Counts of two byte classes in any spans, from one running sum (32 bits each)."""

    def __init__(self, data: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, np.int64)
        np.cumsum((one + (two.astype(np.int64) << 32))[data], out=self.total[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.total[hi] - self.total[lo]
        return both & 0xFFFFFFFF, both >> 32


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it has occurred before."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, later


def describe(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts by document; features, word count and document of every line that has a word."""
    n = len(offsets) - 1
    lo, hi = word_bounds(offsets, data)
    doc = np.searchsorted(offsets, lo, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    # words in windows that occur twice
    hashes, covered = span_hashes(data, lo, hi), np.zeros(len(lo), bool)
    if len(lo) >= WINDOW:
        starts = len(lo) - WINDOW + 1
        window = np.zeros(starts, np.uint64)
        for j in range(WINDOW):
            window = mix(window + hashes[j:j + starts])
        whole = np.flatnonzero(doc[:starts] == doc[WINDOW - 1:])
        twice, _ = _repeats(window[whole] ^ mix(doc[whole] + 1))
        edge = np.zeros(len(lo) + 1, np.int64)
        edge[whole[twice]] += 1  # the places are distinct
        edge[whole[twice] + WINDOW] -= 1
        covered = np.cumsum(edge[:-1]) > 0
    # lines: cut at line feeds and at the borders of documents
    feeds = np.flatnonzero(data == 10)
    line_lo = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_lo = line_lo[line_lo < len(data)]
    line_hi = np.append(line_lo[1:], len(data))[:len(line_lo)]
    line_hi = line_hi - (data[line_hi - 1] == 10)  # the line feed is no part of the line
    line_hi = np.maximum(line_hi, line_lo)
    first, last = np.searchsorted(lo, line_lo), np.searchsorted(lo, line_hi)
    used = last > first
    line_lo, line_hi, first, last = line_lo[used], line_hi[used], first[used], last[used]
    line_doc = np.searchsorted(offsets, line_lo, "right") - 1
    _, dup = _repeats(span_hashes(data, line_lo, line_hi) ^ mix(line_doc + 1))
    words = last - first
    again = np.zeros(len(lo), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first] = False
    before = lambda flags: np.append(0, np.cumsum(flags))
    n_again, n_covered = (x[last] - x[first] for x in (before(again), before(covered)))
    tail, head = data[hi[last - 1] - 1], data[lo[first]]
    symbols = Counts(data, SYMBOL, UPPER)
    n_symbol, n_upper = symbols(line_lo, line_hi)
    n_digit, n_mark = Counts(data, DIGIT, MARK)(line_lo, line_hi)
    n_pipe, size = Counts(data, PIPE, LETTER | DIGIT | SYMBOL | MARK)(line_lo, line_hi)
    size = np.maximum(size, 1)
    features = np.column_stack([
        np.ones(len(words)), np.log1p(words) / 5, n_symbol / size, n_upper / size, n_digit / size, n_mark / size,
        n_again / words, n_covered / words, dup, END[tail], UPPER[head] | (head > 127), n_pipe / words])
    points, _ = Counts(data, POINT, POINT)(lo, hi)
    return {"n_words": n_words, "n_repeat_words": np.bincount(doc[covered], minlength=n),
            "word_chars": np.bincount(doc, points, minlength=n).astype(np.int64),
            "n_symbols": symbols(offsets[:-1], offsets[1:])[0],
            "n_dup_lines": np.bincount(line_doc[dup], minlength=n),
            "features": features, "line_doc": line_doc, "line_words": words}


class LinearChain:
    """Two labels; emission weights by feature, transition and start weights."""

    def __init__(self) -> None:
        self.emit, self.move, self.start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, steps: int = 120, rate: float = 0.1,
            decay: float = 1e-3) -> LinearChain:
        """x: documents x lines x features, y: labels, live: which lines exist (they come first)."""
        d, t = y.shape
        hot = np.eye(2)[y] * live[..., None]
        pairs = live[:, 1:] & live[:, :-1]
        seen = np.einsum("dti,dtj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move, self.start)]
        lse = lambda a, axis: np.logaddexp(a.take(0, axis), a.take(1, axis))
        for step in range(1, steps + 1):
            e = x @ self.emit
            fore, back = np.zeros((d, t, 2)), np.zeros((d, t, 2))
            fore[:, 0] = e[:, 0] + self.start
            for i in range(1, t):
                fore[:, i] = np.where(live[:, i, None], lse(fore[:, i - 1, :, None] + self.move, 1) + e[:, i], fore[:, i - 1])
            for i in range(t - 2, -1, -1):
                back[:, i] = np.where(live[:, i + 1, None], lse(self.move + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
            z = lse(fore[:, -1], 1)
            mine = np.exp(fore + back - z[:, None, None]) * live[..., None]
            both = np.exp(fore[:, :-1, :, None] + self.move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grads = (np.einsum("dtf,dty->fy", x, hot - mine) / d - decay * self.emit,
                     (seen - (both * pairs[..., None, None]).sum((0, 1))) / d - decay * self.move,
                     (hot[:, 0] - mine[:, 0]).mean(0) - decay * self.start)
            for p, g, m in zip((self.emit, self.move, self.start), grads, moments, strict=True):
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Most likely labels; the lines of a document lie together, in order."""
        e, n = (features @ self.emit).tolist(), len(doc)
        new = np.append(True, doc[1:] != doc[:-1]).tolist() if n else []
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        back0, back1, label, a, b = [0] * n, [1] * n, np.zeros(n, np.int8), 0.0, 0.0
        end = [0] * n  # the better label if the document ended here
        for i in range(n):
            x, y = e[i]
            if new[i]:
                a, b = s0 + x, s1 + y
            else:
                if a + m00 < b + m10:
                    back0[i], na = 1, b + m10
                else:
                    na = a + m00
                if a + m01 > b + m11:
                    back1[i], nb = 0, a + m01
                else:
                    nb = b + m11
                a, b = na + x, nb + y
            end[i] = int(b >= a)
        now = 0
        for i in range(n - 1, -1, -1):
            if i == n - 1 or new[i + 1]:
                now = end[i]
            label[i] = now
            now = back1[i] if now else back0[i]
        return label


def _train_rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            found = describe(*utf8(part.column(part.schema.get_field_index(text))))
            keep = [found["features"][found["line_doc"] == i][:TRAIN_LINES] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("label")), pa.array([k.ravel().tolist() for k in keep], pa.list_(pa.float64()))],
                names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> LinearChain | None:
    """Fit the field on the ``TRAIN_DOCS`` labelled documents that come first in a seeded hash order: one row for
    each id and label, with the text of the smallest hash."""
    some = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
            .orderBy(hash_id("id", seed=4), "id", "label").limit(TRAIN_DOCS))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .filter("text is not null").join(F.broadcast(some), "id")  # at most TRAIN_DOCS labels
            .groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("label", "text")
            .mapInArrow(partial(_train_rows, text="text"), "label int, features array<double>")
            .orderBy("label", "features").collect())  # at most TRAIN_DOCS rows
    rows = [(r["label"], np.array(r["features"]).reshape(-1, N_FEATURES)) for r in rows if r["features"]]
    if {bool(y) for y, _ in rows} != {True, False}:
        return None
    t = max(len(f) for _, f in rows)
    x, live = np.zeros((len(rows), t, N_FEATURES)), np.zeros((len(rows), t), bool)
    y = np.array([[CONTENT if label else BOILERPLATE] * t for label, _ in rows])
    for i, (_, f) in enumerate(rows):
        x[i, :len(f)], live[i, :len(f)] = f, True
    return LinearChain().fit(x, y, live)


def judge(offsets: np.ndarray, data: np.ndarray, model: LinearChain | None) -> dict[str, np.ndarray]:
    found = describe(offsets, data)
    n = found["n_words"]
    label = model.decode(found["features"], found["line_doc"]) if model else np.full(len(found["line_doc"]), CONTENT)
    content = np.bincount(found["line_doc"], found["line_words"] * (label == CONTENT), minlength=len(n))
    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * n)
    share = content / np.maximum(n, 1)
    return {k: found[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {
        "base_failed": failed, "content_share": share, "kept": ~failed & (share >= MIN_CONTENT)}


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, content_share double, kept boolean")


def _judged(batches: Iterator[pa.RecordBatch], text: str, model: LinearChain | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            out = judge(*utf8(part.column(part.schema.get_field_index(text))), model)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in out.values())],
                                             names=[part.schema.names[0], *out])


def _kept(batches: Iterator[pa.RecordBatch], text: str, model: LinearChain | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            yield part.filter(pa.array(judge(*utf8(part.column(part.schema.get_field_index(text))), model)["kept"]))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return own.mapInArrow(partial(_judged, text="text", model=train(docs, labels)), f"doc_id {kind}, {FIELDS}")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that are kept, with all their columns."""
    return docs.mapInArrow(partial(_kept, text="text", model=train(docs, labels)), docs.schema)
