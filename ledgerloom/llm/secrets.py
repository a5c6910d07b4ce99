"""Operator 3, secret scans: a character convolutional network over every candidate and its context.

Candidates are the findings of three base patterns and every run of ``LEAST`` or more token characters, of any
class, that lies outside them or is left over beside one.  A small convolutional network in numpy reads windows of bytes that slide over the whole
candidate, from ``BEFORE`` bytes before it to as many after it; its score is the highest of them.  Scores are
calibrated (Platt) on findings kept out of the fit, and the threshold keeps ``RECALL`` of those at the highest
precision that allows.  Base findings
stay whatever their score; other candidates at or above the threshold are added as kind ``model``.

Labelled values are the base findings (positive), candidates without a letter and UUIDs (negative: card and telephone
numbers, dates, counters, ids) and other candidates (negative, but for those whose value a network fitted without them scores
like a finding's: they may be secrets; words of small letters and the rest apart, so that few are not lost among many) of all
documents: every distinct value of the table is learned from, by the mention whose context comes first by a hash and up to
``TRAIN_WINDOWS`` windows of that, evenly spaced.  Some are shown without their context, so that the network also learns what the
value itself looks like.  A label weighs as much as its values, ``LABEL_WEIGHT`` at most, however many they are.

Values are dealt by hash into blocks of about ``BLOCK_BYTES`` of text each.  Tasks fit copies of the network on the blocks
of a round, the copies are averaged (in whole numbers, so the order does not matter) and the next round goes on from there;
every value is shown at least once.  The cut for doubtful values, the calibration and the threshold are computed from counts of the
scores, to a ``GRID``-th, of all findings and of all values kept out of the fit.  With fewer than 10 distinct values of a label in
the whole table only base findings are returned.

Edge cases: a null text is empty and has no spans; repeated rows are scanned alike; a text of any length is
scanned whole; matches never cross documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, span_hashes, staged, utf8

LABEL_WEIGHT, RECALL, SEED = 2000, 0.98, 31
LABEL_SLICE = 4 << 20  # text bytes whose values are told apart at once
BLOCK_BYTES = 8 << 20  # text for each block of distinct values
VISITS, PASSES, ROUNDS = 400_000, 72, 8  # values shown in a fit, at least; passes over few values, at most; averages
BATCH, SHARE = 128, 16  # values of a step, and of a label that is rare in the block
RATE = 0.02  # of the first step
GRID = 256  # scores are counted to this part of one
DOUBT = 0.1  # a candidate is doubtful as a negative if it scores above this share of the findings
BEFORE, AFTER = 24, 40  # bytes of a window before its place and from it on
LEAST = 8  # characters of a candidate that no base pattern finds
STEP, TRAIN_WINDOWS = 16, 16  # bytes from a window's place to the next; windows of a candidate in training
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")  # what ASSIGN begins with, in small letters
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_LEAST = 24
HEX_BYTE = np.zeros(256, bool)
HEX_BYTE[list(b"0123456789abcdef")] = True

TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

# symbols of the network: lower, upper and digit characters by themselves, punctuation, blanks, other bytes
SYMBOLS = np.full(256, 1, np.int64)
for _i, _b in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789+/_=-:.\"'@, \n", 4):
    SYMBOLS[_b] = _i
for _b in range(65, 91):
    SYMBOLS[_b] = 2 + 52 + (_b - 65)
SYMBOLS[0xFF] = 0  # the border of a document
INSIDE = 80  # added to the symbols of the candidate itself, so that a neighbour's are not taken for its own
N_SYMBOLS, EMBED, WIDTH, FILTERS = 2 * INSIDE, 12, 5, 24


def maximal(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``least`` or more bytes that are ``inside``, which has one more byte on both sides."""
    border = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = border[::2], border[1::2]
    long = hi - lo >= least
    return lo[long], hi[long]


def runs(data: np.ndarray, base: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``LEAST`` or more token characters outside the base findings."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TOKEN[data]
    for a, b, _, _ in base:
        inside[a + 1:b + 1] = False
    return maximal(inside, LEAST)


def assignments(blob: bytes) -> Iterator[re.Match]:
    """The matches of ``ASSIGN`` in turn, tried only where one of its words stands."""
    low, at = blob.lower(), []
    for word in ASSIGN_WORDS:
        i = low.find(word)
        while i >= 0:
            at.append(i)
            i = low.find(word, i + 1)
    end = 0
    for i in sorted(at):
        if i >= end and (m := ASSIGN.match(blob, i)):
            end = m.end()
            yield m


def base_findings(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the base findings, in byte places."""
    blob = data.tobytes()
    found = [(m.start(), m.end(), 0, m.start(2)) for m in assignments(blob) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(blob) if m.end() - m.start() >= 20]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = HEX_BYTE[data]
    found += [(a, b, 2, a) for a, b in zip(*(x.tolist() for x in maximal(inside, HEX_LEAST)), strict=True)]
    return sorted(found)


def places(lo: np.ndarray, hi: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The places of the windows that slide over each candidate, the last one with ``BEFORE`` bytes behind its
    end, and the candidate of each window; with ``most``, steps wide enough for that many windows."""
    last = np.maximum(hi - (AFTER - BEFORE), lo)
    step = np.maximum(STEP, -(-(last - lo) // (most - 1))) if most else np.full(len(lo), STEP)
    n = 1 - (lo - last) // step
    own = np.repeat(np.arange(len(lo)), n)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(lo[own] + nth * step[own], last[own]), own


def windows(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Symbols of the bytes around each place in the candidate [lo, hi); from the text's border on there is nothing."""
    byte = at[:, None] + np.arange(-BEFORE, AFTER)
    found = SYMBOLS[data[np.clip(byte, 0, len(data) - 1)]] * ((byte >= 0) & (byte < len(data)))
    after = np.minimum.accumulate(found[:, BEFORE:] > 0, axis=1)
    before = np.minimum.accumulate(found[:, BEFORE - 1::-1] > 0, axis=1)[:, ::-1]
    return (found + INSIDE * ((byte >= lo[:, None]) & (byte < hi[:, None]))) * np.concatenate([before, after], axis=1)


def separated(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a byte between them that no UTF-8 text has, and where each begins."""
    return np.insert(data, offsets[1:-1], 0xFF), offsets[:-1] + np.arange(len(offsets) - 1)


class CharNet:
    """Embedding, one convolution, maximum over places, logistic output; then Platt's two numbers."""

    def __init__(self, seed: int = SEED) -> None:
        g = np.random.default_rng(seed)
        self.p = [g.normal(0, 0.3, (N_SYMBOLS, EMBED)), g.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS),
                  g.normal(0, 0.2, FILTERS), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _convolved(self, x: np.ndarray) -> np.ndarray:
        """rows x places x filters, without the bias, the products of symbol and place looked up."""
        embed, kernel = self.p[:2]
        count = x.shape[1] - WIDTH + 1
        conv = (embed @ kernel[:EMBED]).astype(np.float32).take(x[:, :count], axis=0)
        for j in range(1, WIDTH):
            conv += (embed @ kernel[j * EMBED:(j + 1) * EMBED]).astype(np.float32).take(x[:, j:j + count], axis=0)
        return conv

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The convolution, each filter's best place, its value there and the raw score."""
        conv = self._convolved(x)
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.p[2]
        return conv, best, top, np.maximum(top, 0) @ self.p[3] + self.p[4]

    def raw(self, x: np.ndarray, rows: int = 64) -> np.ndarray:
        """The raw scores of ``_forward``; few rows at a time, place by place, so that they stay in the processor's cache."""
        embed, kernel = self.p[:2]
        products = [(embed @ kernel[j * EMBED:(j + 1) * EMBED]).astype(np.float32) for j in range(WIDTH)]
        count = x.shape[1] - WIDTH + 1
        top = np.empty((len(x), FILTERS))
        conv, more = np.empty((2, count, min(rows, len(x)), FILTERS), np.float32)
        for i in range(0, len(x), rows):
            at = np.ascontiguousarray(x[i:i + rows].T)
            if at.shape[1] < conv.shape[1]:
                conv, more = np.empty((2, count, at.shape[1], FILTERS), np.float32)
            np.take(products[0], at[:count], axis=0, out=conv, mode="clip")
            for j in range(1, WIDTH):
                np.take(products[j], at[j:j + count], axis=0, out=more, mode="clip")
                conv += more
            top[i:i + rows] = conv.max(0) + self.p[2]
        return np.maximum(top, 0) @ self.p[3] + self.p[4]

    def highest(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
        """The highest raw score of the windows over each candidate; few windows are held at a time."""
        at, own = places(lo, hi)
        out = np.full(len(lo), -np.inf)
        for i in range(0, len(at), chunk):
            mine = own[i:i + chunk]
            np.maximum.at(out, mine, self.raw(windows(data, at[i:i + chunk], lo[mine], hi[mine])))
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -60, 60)))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted logistic loss.  Only the best place of a filter counts, so the gradient of the products of
        symbol and place is a sum over those."""
        embed, kernel, _, out, _ = self.p
        _, best, top, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        dtop = dz[:, None] * out * (top > 0)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
        dembed, dkernel = np.zeros_like(embed), np.zeros_like(kernel)
        for j in range(WIDTH):
            at, part = x[rows, best + j] * FILTERS + filters, slice(j * EMBED, (j + 1) * EMBED)
            d = np.bincount(at.ravel(), dtop.ravel(), N_SYMBOLS * FILTERS).reshape(N_SYMBOLS, FILTERS)
            dembed += d @ kernel[part].T
            dkernel[part] = embed.T @ d
        return [dembed, dkernel, dtop.sum(0), np.maximum(top, 0).T @ dz, dz.sum(keepdims=True)]

    def step(self, grads: list[np.ndarray], moments: list[np.ndarray], n: int, rate: float) -> None:
        """The ``n``-th step of Adam; ``moments`` are the first ones, then the second ones, as ``p``."""
        for p, d, a, v in zip(self.p, grads, moments, moments[len(self.p):]):
            a += 0.1 * (d - a)
            v += 0.01 * (d * d - v)
            p -= rate * (a / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray) -> CharNet:
        """Platt's scaling of raw scores by Newton steps, a score weighing ``weight``, then the threshold under the
        recall constraint, a score counting ``count`` times."""
        w = np.array([1.0, 0.0])
        a = np.column_stack([z, np.ones(len(z))])
        positive, negative = weight[y > 0].sum(), weight[y == 0].sum()
        smooth = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
            hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, a.T @ (weight * (p - smooth)) + 1e-3 * (w - [1, 0])), -1, 1)
        self.scale, self.shift = float(max(w[0], 1e-3)), float(w[1])
        score = self.score(z)
        most = counted_quantile(score[y > 0], count[y > 0], 1 - RECALL)  # the highest threshold that keeps the recall
        other = score[(y == 0) & (score < most)]  # half way down to the next negative costs no precision
        self.threshold = float((most + other.max(initial=0.0)) / 2)
        return self


def counted_quantile(value: np.ndarray, count: np.ndarray, share: float) -> float:
    """The value with this share of all below it, each of ``value`` coming ``count`` times."""
    order = np.argsort(value)
    ends = np.cumsum(count[order])
    return float(value[order][np.searchsorted(ends, int(share * ends[-1]), "right")])


# labels: base finding; other candidates: of small letters, without letters or a UUID (no secret by its form), the rest
SMALL, FINDING, PLAIN, MIXED = 0, 1, 2, 3
LETTER, LOW = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LOW[97:123] = True


def form(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The labels of candidates outside the base findings."""
    letters, low = (np.append(0, np.cumsum(of[data])) for of in (LETTER, LOW))
    out = np.where(letters[hi] == letters[lo], PLAIN, np.where(low[hi] - low[lo] == hi - lo, SMALL, MIXED))
    for i in np.flatnonzero(hi - lo == 36):
        if (data[lo[i] + np.array([8, 13, 18, 23])] == ord("-")).all():
            out[i] = PLAIN
    return out


def _label_rows(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The labelled values of each slice, with a hash of the context (``mention``) and the windows of the mention that has
    the least.  A value seen before in the partition comes again only with a smaller one; ``most`` are remembered."""
    seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 4
    for batch in batches:
        for part in slices(batch, text, LABEL_SLICE):
            data, begins = separated(*utf8(part.column(part.schema.get_field_index(text))))
            base = base_findings(data)
            mine = np.array([(v, b) for _, b, _, v in base], np.int64).reshape(-1, 2)
            lo, hi = runs(data, base)
            kind = form(data, lo, hi)
            borders = np.append(begins, len(data) + 1)
            lo, hi, kind = np.append(mine[:, 0], lo), np.append(mine[:, 1], hi), np.append(np.full(len(mine), FINDING), kind)
            own = np.searchsorted(begins, lo, "right") - 1
            around = np.maximum(lo - BEFORE, borders[own]), np.minimum(hi + AFTER, borders[own + 1] - 1)
            hashes = span_hashes(data, np.append(lo, around[0]), np.append(hi, around[1])).view(np.int64).reshape(2, -1)
            for label in (FINDING, SMALL, PLAIN, MIXED):
                a, b, key, mention = (x[kind == label] for x in (lo, hi, *hashes))
                if not len(a):
                    continue
                old = len(seen[label][0])
                keys, mentions = np.append(seen[label][0], key), np.append(seen[label][1], mention)
                order = np.lexsort((mentions, keys))
                order = order[np.append(True, np.diff(keys[order]) != 0)]
                chosen = order[order >= old] - old
                seen[label] = (keys[order], mentions[order]) if len(order) <= most else (key[chosen], mention[chosen])
                for i in range(0, len(chosen), 8192):
                    few = chosen[i:i + 8192]
                    at, of = places(a[few], b[few], TRAIN_WINDOWS)
                    flat = windows(data, at, a[few][of], b[few][of]).astype(np.uint8).tobytes()
                    ends = np.append(0, np.searchsorted(of, np.arange(len(few)), "right") * (BEFORE + AFTER)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(few), label, np.int32)), pa.array(key[few]), pa.array(mention[few]),
                         pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(ends), pa.py_buffer(flat)])],
                        names=["label", "key", "mention", "windows"])


BLOCK = "block long, small long, finding long, plain long, mixed long, labels binary, sizes binary, windows binary"


def _block(rows: pa.Table) -> pa.Table:
    """The values of a block as one row, by label and key: how many of each label, their labels, how many windows each has, the
    windows."""
    rows = rows.sort_by([("label", "ascending"), ("key", "ascending")]).combine_chunks()
    label, flat = rows["label"].to_numpy(), rows["windows"].to_pylist()
    sizes = np.array([len(w) // (BEFORE + AFTER) for w in flat], np.uint8)
    return pa.table({"block": rows["block"][:1], **{n: pa.array([int((label == k).sum())]) for k, n in enumerate(("small", "finding", "plain", "mixed"))},
                     "labels": pa.array([label.astype(np.uint8).tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                     "windows": pa.array([b"".join(flat)], pa.binary())})


def bare(w: np.ndarray) -> np.ndarray:
    """Windows without the context of the value."""
    return np.where(w < INSIDE, 0, w)


class Values:
    """The values of a block: ``label``, their windows ``x`` from ``begins`` on, ``odd`` (the half they are in) and ``held`` (kept
    out of the fit); both are dealt in turn within a label, on from another place in each block."""

    def __init__(self, block: int, labels: bytes, sizes: bytes, flat: bytes) -> None:
        self.block, self.label = block, np.frombuffer(labels, np.uint8)
        self.size = np.frombuffer(sizes, np.uint8).astype(np.int64)
        self.x = np.frombuffer(flat, np.uint8).reshape(-1, BEFORE + AFTER)
        self.begins = np.cumsum(self.size) - self.size
        nth = np.arange(len(self.label)) - np.searchsorted(self.label, self.label) + block
        self.odd, self.held = nth % 2 == 1, nth // 2 % 4 == 3
        self.sure = (self.label == FINDING) | (self.label == PLAIN)

    def highest(self, net: CharNet, on: np.ndarray, dress=lambda w: w) -> np.ndarray:
        """The highest raw score of each value in ``on``, to a ``GRID``-th, in whole numbers."""
        out = np.zeros(len(on), np.int64)
        for i in range(0, len(on), 4096):
            few = on[i:i + 4096]
            size, ends = self.size[few], np.cumsum(self.size[few])
            at = np.repeat(self.begins[few] - ends + size, size) + np.arange(ends[-1])
            raw = net.raw(dress(self.x[at]).astype(np.int64))
            out[i:i + 4096] = np.rint(np.clip(np.maximum.reduceat(raw, ends - size), -1e6, 1e6) * GRID)
        return out

    def clean(self, doubt: list[tuple[CharNet, float]], on: np.ndarray) -> np.ndarray:
        """Which of ``on`` are no doubtful negatives: by the value alone, the network fitted on the other half scores them no
        higher than the cut of that network."""
        ok = self.sure[on].copy()
        for half, (net, cut) in enumerate(doubt):
            part = np.flatnonzero(~ok & (self.odd[on] == half) & ~self.sure[on])
            ok[part] = self.highest(net, on[part], bare) <= cut
        return ok


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[Values]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Values(*(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("block", "labels", "sizes", "windows")))


# which values a fit learns from: those of the even or odd half, or the clean ones that are not held
EVEN, ODD, ALL = 0, 1, 2


def _rounds(batches: Iterator[pa.RecordBatch], state: list[np.ndarray], done: int, weights: np.ndarray, which: int,
            doubt: list[tuple[CharNet, float]], passes: dict[int, int], turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """Fit a copy of the network (``state``: its numbers, then Adam's moments, after ``done`` steps) on each block of the
    round, as often as ``passes`` says; the sums over the copies, in whole numbers, with their count and steps."""
    total, copies, steps = None, 0, 0
    for v in _values(batches):
        if v.block not in passes:
            continue
        on = np.flatnonzero(~v.held if which == ALL else v.odd == which)
        if which == ALL:
            on = on[v.clean(doubt, on)]
        own = [on[v.label[on] == k] for k in range(4)]
        own = [o for o in own if len(o)]
        if not own:
            continue
        net, moments = CharNet(), [a.copy() for a in state[5:]]
        net.p = [a.copy() for a in state[:5]]
        g = np.random.default_rng([SEED, which, v.block, turn])
        quota = [min(max(SHARE, round(BATCH * len(o) / len(on))), len(o)) for o in own]
        count = max(-(-len(o) // q) for o, q in zip(own, quota, strict=True))
        weight = np.repeat([weights[v.label[o[0]]] * len(o) / q for o, q in zip(own, quota, strict=True)], quota)
        weight /= weight.sum()
        n, last = done, done + count * passes[v.block]
        for _ in range(passes[v.block]):
            order = [np.concatenate([g.permutation(o) for _ in range(-(-count * q // len(o)))]) for o, q in zip(own, quota, strict=True)]
            for i in range(count):
                b = np.concatenate([o[i * q:(i + 1) * q] for o, q in zip(order, quota, strict=True)])
                view = g.integers(3, size=len(b))  # the first window, any, any without its context
                x = v.x[v.begins[b] + np.where(view > 0, g.integers(v.size[b]), 0)].astype(np.int64)
                x = np.where((view == 2)[:, None], bare(x), x)
                n += 1
                rate = RATE * (1 - (turn + (n - done) / (last - done + 1)) / turns)  # falls to nothing over the fit
                net.step(net.gradient(x, (v.label[b] == FINDING).astype(float), weight), moments, n, rate)
        mine = np.concatenate([a.ravel() for a in (*net.p, *moments)])
        mine = np.rint(mine * (1 << 40)).astype(np.int64)
        total = mine if total is None else total + mine
        copies, steps = copies + 1, steps + n - done
    if total is not None:
        total = np.concatenate([[copies, steps], total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])


def fitted(blocks: DataFrame, counts: dict[int, int], weights: np.ndarray, which: int, doubt: list[tuple[CharNet, float]]) -> CharNet:
    """The network fitted on all values of ``which``; ``counts`` says how many each block has."""
    net = CharNet()
    state = [*net.p, *(np.zeros_like(a) for a in net.p * 2)]
    names = sorted(counts)
    passes = min(max(VISITS // max(sum(counts.values()), 1), 1), PASSES)
    visits = [b for _ in range(passes) for b in names]
    turns, done = ROUNDS if len(names) > 1 else 1, 0
    for turn in range(turns):
        own: dict[int, int] = {}
        for b in visits[len(visits) * turn // turns:len(visits) * (turn + 1) // turns]:
            own[b] = own.get(b, 0) + 1
        if not own:
            continue
        task = partial(_rounds, state=state, done=done, weights=weights, which=which, doubt=doubt, passes=own, turn=turn, turns=turns)
        rows = (blocks.filter(F.col("block").between(min(own), max(own))).mapInArrow(task, "place long, value long")
                .groupBy("place").agg(F.sum("value").alias("value")).collect())
        if not rows:  # none of the round's blocks has a value of ``which``
            continue
        total = np.zeros(len(rows))
        for r in rows:
            total[r["place"]] = r["value"]
        done += round(total[1] / total[0])
        mean, at = total[2:] / total[0] / (1 << 40), np.cumsum([a.size for a in state])
        state = [part.reshape(a.shape) for part, a in zip(np.split(mean, at[:-1]), state, strict=True)]
    net.p = state[:5]
    return net


def _scores(batches: Iterator[pa.RecordBatch], net: CharNet | None, doubt: list[tuple[CharNet, float]], cut: list[CharNet],
            held: bool) -> Iterator[pa.RecordBatch]:
    """Counts of scores by ``label`` and ``part``: with ``cut`` of the findings by the network fitted on the other half
    (``part``), without context; else of the clean values (those ``held`` only), with and without context, or with no network just
    how many they are."""
    for v in _values(batches):
        found = []
        if cut:
            for half, other in enumerate(cut):
                on = np.flatnonzero((v.label == FINDING) & (v.odd == half))
                found.append((on, np.full(len(on), half), v.highest(other, on, bare)))
        else:
            on = np.flatnonzero(v.held) if held else np.arange(len(v.label))
            on = on[v.clean(doubt, on)]
            for part, dress in enumerate((lambda w: w, bare) if net else (None,)):
                found.append((on, np.full(len(on), part), v.highest(net, on, dress) if net else np.zeros(len(on), np.int64)))
        on, part, score = (np.concatenate(c) for c in zip(*found, strict=True))
        rows, count = np.unique(np.column_stack([v.label[on], part, score]).reshape(-1, 3).astype(np.int64), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), pa.array(count)], names=["label", "part", "score", "n"])


def scores(blocks: DataFrame, net: CharNet | None = None, doubt: list[tuple[CharNet, float]] = [], cut: list[CharNet] = [],
           held: bool = False) -> np.ndarray:
    """Rows of label, part, score and how often it comes, over all blocks."""
    rows = (blocks.mapInArrow(partial(_scores, net=net, doubt=doubt, cut=cut, held=held), "label long, part long, score long, n long")
            .groupBy("label", "part", "score").agg(F.sum("n").alias("n")).orderBy("label", "part", "score").collect())
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)


def train(docs: DataFrame, text_col: str = "text") -> CharNet | None:
    own = docs.select(F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    found = (own.mapInArrow(partial(_label_rows, text="text"), "label int, key long, mention long, windows binary")
             .withColumn("block", F.pmod("key", F.lit(n))).repartition(n, "block")
             .groupBy("block", "label", "key").agg(F.min_by("windows", "mention").alias("windows")))
    blocks = staged(found.groupBy("block").applyInArrow(_block, BLOCK), "secret-values")
    sizes = {r["block"]: np.array(r[1:]) for r in blocks.select("block", "small", "finding", "plain", "mixed").collect()}
    total = sum(sizes.values(), np.zeros(4, np.int64))
    if min(total[FINDING], total.sum() - total[FINDING]) < 10:
        return None
    weights = np.minimum(total, LABEL_WEIGHT) / np.maximum(total, 1)
    halves = [fitted(blocks, {b: int(c.sum()) // 2 for b, c in sizes.items()}, weights, half, []) for half in (ODD, EVEN)]
    rows = scores(blocks, cut=halves)
    doubt = []
    for half, net in enumerate(halves):
        mine = rows[rows[:, 1] == half]
        doubt.append((net, counted_quantile(mine[:, 2], mine[:, 3], DOUBT) if len(mine) else -np.inf))
    if total[PLAIN] < 10:
        rows = scores(blocks, doubt=doubt)
        if rows[rows[:, 0] != FINDING, 3].sum() < 10:
            return None
    net = fitted(blocks, {b: int(c.sum()) for b, c in sizes.items()}, weights, ALL, doubt)
    for held in (True, False):  # values so few that none of a label was kept out are calibrated on as well
        rows = scores(blocks, net, doubt, held=held)
        positive = rows[:, 0] == FINDING
        if positive.any() and not positive.all():
            break
    return net.calibrate(rows[:, 2] / GRID, positive.astype(float), rows[:, 3], rows[:, 3] * weights[rows[:, 0]])


def scan(offsets: np.ndarray, data: np.ndarray, net: CharNet | None) -> list[list[tuple[int, int, int, float]]]:
    """For each text its spans (start, end, kind, score) in code points, by start, then kind; kind 3 is the
    network's own."""
    glued, begins = separated(offsets, data)
    base = base_findings(glued)
    spans = np.array(base, np.int64).reshape(-1, 4)
    (start, end, kind, value), score = spans.T, np.ones(len(spans))
    if net:
        lo, hi = runs(glued, base)
        mine, score = net.score(net.highest(glued, lo, hi)), net.score(net.highest(glued, value, end))
        ok = mine >= net.threshold
        start, end, kind = np.append(start, lo[ok]), np.append(end, hi[ok]), np.append(kind, np.full(ok.sum(), 3))
        score = np.append(score, mine[ok])
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(begins))]
    if not len(start):
        return out
    point = np.zeros(len(glued) + 1, np.int64)
    np.cumsum((glued & 0xC0) != 0x80, out=point[1:])
    doc = np.searchsorted(begins, start, "right") - 1
    origin = point[begins[doc]]
    for d, *span in zip(*(c.tolist() for c in (doc, point[start] - origin, point[end] - origin, kind, score)), strict=True):
        out[d].append(tuple(span))
    for own in out:
        own.sort(key=lambda s: (s[0], s[2]))
    return out


FIELDS = "n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, max_score double"


def _scanned(batches: Iterator[pa.RecordBatch], text: str, net: CharNet | None) -> Iterator[pa.RecordBatch]:
    names = [*BASE_KINDS, "model"]
    for batch in batches:
        for part in slices(batch, text):
            rows = scan(*utf8(part.column(part.schema.get_field_index(text))), net)
            joined = [",".join(f"{names[k]}:{a}:{b}" for a, b, k, _ in r) for r in rows]
            base = [",".join(f"{names[k]}:{a}:{b}" for a, b, k, _ in r if k < 3) for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(joined),
                 pa.array([max((s[3] for s in r), default=None) for r in rows], pa.float64())],
                names=[part.schema.names[0], "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "max_score"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharNet | None = None) -> DataFrame:
    own = docs.select(id_col, text_col)
    return own.mapInArrow(partial(_scanned, text=text_col, net=net), f"{id_col} {dict(own.dtypes)[id_col]}, {FIELDS}")


def op3(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs, net=train(docs))
