"""Operator 11, periodic run detection: maximal-pair enumeration over the LCP-interval tree.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Two places i < j of a
document whose words agree for exactly L words, and not one word further to the left, are a maximal pair; with
L >= 2 (j - i) the stretch [i, j + L) has period j - i and can be extended on neither side, so the pairs whose
distance satisfies the length constraints *are* the runs.  A pair at a multiple of the period covers the same
stretch; the smallest distance of a stretch is its period.

Steps, for a slice of whole documents at a time:

* a pair needs 16 common words at least (L + q >= 24, L >= 2 q), and the places of a run that repeat their 16
  words do so inside one unbroken stretch of such places.  Other places are leaves above depth 16 of the tree
  and are left out (a few passes of exact counting, words being compared through their numbers);
* the suffixes of the stretches are sorted by prefix doubling, common prefixes come from the ranks of its
  rounds, never across documents;
* the LCP-interval tree is walked bottom-up.  An interval holds its places in text order, each with the class of
  its left word; a child meets what its parent has gathered, the smaller against the larger.  Only pairs of
  different classes within half the depth count.  Within that reach the places are a progression in the period
  of the common words, so all places to the right are of one class, and of those to the left only the farthest
  can be of another class than the place itself: one look on each side finds every pair and no other is walked.

Edge cases: a null, empty or blank text has no words and no runs; repeated rows count as separate documents;
rows without id are never planted; an empty table gives no rows; other columns are not read.  A document is the
unit: memory is about 200 bytes for each word of a slice of ``SLICE`` text bytes or of one longer document.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

LEAST, TIMES = 24, 3  # words of a run, and its least exponent
SLICE = 2 << 20
PASSES = 8  # rounds of leaving out places; more would only save work


def planted(n: int, doc_id: int) -> np.ndarray | None:
    """Where the query's planted documents take their words from; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def depth(least: int = LEAST, times: int = TIMES) -> int:
    """Common words that any pair of a run has at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k-word strings starting at each place (as many as fit), equal for equal strings."""
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)

    length, code = 1, words
    while length * 2 <= k:
        code = joined(code[:-length], code[length:])
        length *= 2
    return code if length == k else joined(code[:len(words) - k + 1], code[k - length:])


def suspects(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next k words are found again in the same stretch of such places, and the stretches' numbers.
    A stretch is unbroken in words: its places are less than ``k`` apart, as those of any run are."""
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none
    gram = grams(words, k)
    at = np.flatnonzero(np.arange(len(gram)) + k <= ends[:len(gram)])
    part = ends[at]
    for _ in range(PASSES):
        code = pd.factorize(part * len(words) + gram[at])[0]
        again = np.bincount(code, minlength=1)[code] > 1 if len(code) else np.zeros(0, bool)
        if again.all():
            break
        at = at[again]
        part = np.cumsum(np.diff(at, prepend=-k) >= k)
    return at, part


def suffix_order(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all parts in an order that keeps common prefixes together, and how many words each has
    in common with the one before it (0 for the first).  Suffixes end with their part."""
    n = len(words)
    rank = np.unique(part * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64)
    levels, length = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if int(rank.max()) == n - 1:
            break
        after = np.zeros(n, np.int64)
        inside = part[length:] == part[:-length]
        after[:n - length][inside] = rank[length:][inside] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        length *= 2
    order = np.argsort(rank)
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        own = np.append(levels[level], [-1])  # one past the end equals nothing else
        same = (own[i] == own[j]) & (i < n) & (j < n)
        step = same.astype(np.int64) << level
        i, j = np.minimum(i + step, n), np.minimum(j + step, n)
        common[1:] += step
    return order, common


def meet(large: list[int], small: list[int], deep: int, left: list[int], out: list[tuple[int, int, int]], least: int, times: int) -> None:
    """Report (i, j, common words) of the maximal pairs between two children of an interval of depth ``deep``
    whose distance satisfies the length constraints."""
    reach = deep // (times - 1)
    for x in small:
        own, k = left[x], bisect_left(large, x)
        if k < len(large) and large[k] - x <= reach and left[large[k]] != own:
            for y in itertools.takewhile(lambda y: y - x <= reach, itertools.islice(large, k, None)):
                if y - x + deep >= least:
                    out.append((x, y, deep))
        far = bisect_left(large, x - reach, 0, k)
        if far < k and left[large[far]] != own and x - large[far] + deep >= least:
            out.append((large[far], x, deep))


def maximal_pairs(order: list[int], common: list[int], left: list[int], k: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Walk the interval tree above depth ``k`` bottom-up: ``order`` are places in suffix order, ``common`` the
    words in common with the place before, ``left`` the word before each place."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []

    def merged(a: list[int], b: list[int], deep: int) -> list[int]:
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        meet(large, small, deep, left, out, least, times)
        for x in small:
            insort(large, x)
        return large

    for at, place in enumerate(order):
        deep = common[at + 1] if at + 1 < len(order) else 0
        child = [place]
        while stack and stack[-1][0] > deep:
            d, held = stack.pop()
            child = merged(held, child, d)
        if deep < k:
            continue
        if stack and stack[-1][0] == deep:
            stack[-1] = (deep, merged(stack[-1][1], child, deep))
        else:
            stack.append((deep, child))
    return out


def runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of documents lying one after the other; ``words`` are their words'
    numbers, ``ends`` the end of each word's document."""
    if times < 3:
        raise ValueError("the walk's reach holds for runs of three periods and more")
    k = depth(least, times)
    at, part = suspects(words, ends, k)
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(part, prepend=-1) != 0)
    size = at[np.append(first[1:], len(at)) - 1] - at[first] + k
    before = np.append(0, np.cumsum(size))
    place = np.arange(before[-1]) - np.repeat(before[:-1], size) + np.repeat(at[first], size)
    order, common = suffix_order(words[place], np.repeat(np.arange(len(size)), size))
    near = common >= k
    some = near | np.append(near[1:], False)  # the others share fewer than k words with any place
    begins = np.flatnonzero(np.append(True, np.diff(ends) != 0))
    left = np.append(-1, words[:-1])
    left[begins] = -1
    found: dict[tuple[int, int], int] = {}
    for x, y, deep in maximal_pairs(place[order[some]].tolist(), np.where(near, common, 0)[some].tolist(), left.tolist(), k, least, times):
        found[x, y + deep] = min(y - x, found.get((x, y + deep), y - x))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties to the smallest start, then period."""
    top = None
    for run in found:
        if top is None:
            top = run
            continue
        a, b = run[1] * top[2], top[1] * run[2]
        if a > b or a == b and (run[0], run[2]) < (top[0], top[2]):
            top = run
    return top


def _documents(batches: Iterator[pa.RecordBatch], plant: bool, least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            offsets, data = utf8(part.column(1))
            number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
            docs = []
            for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.array([number[w] for w in data[a:b].tobytes().split()], np.int64)  # splits at \x20 and \x09-\x0D
                origin = planted(len(own), doc_id) if plant and doc_id is not None else None
                docs.append(own if origin is None else own[origin])
            word = list(number)
            sizes = np.array([len(d) for d in docs], np.int64)
            edge = np.append(0, np.cumsum(sizes))
            words = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            per_doc = defaultdict(list)
            for start, length, period in runs(words, np.repeat(edge[1:], sizes), least, times):
                doc = int(np.searchsorted(edge, start, "right")) - 1
                per_doc[doc].append((start - int(edge[doc]), length, period))
            rows = []
            for i, own in enumerate(docs):
                keep = own
                if i in per_doc:
                    change = np.zeros(len(own) + 1, np.int64)
                    for start, length, period in per_doc[i]:
                        change[start + period] += 1
                        change[start + length] -= 1
                    keep = own[np.cumsum(change[:-1]) == 0]
                rows.append((per_doc.get(i, []), b" ".join([word[w] for w in keep.tolist()]).decode()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes),
                 pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in rows], RUNS),
                 pa.array([best(r) and dict(zip(("start", "length", "period"), best(r))) for r, _ in rows], RUNS.value_type),
                 pa.array([t for _, t in rows], pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_words``, ``runs`` (by start, then period), ``best`` and
    ``collapsed``, the text without the words that a run repeats after its first period."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = "struct<start:long,length:long,period:long>"
    return own.mapInArrow(partial(_documents, plant=plant, least=least, times=times),
                          f"doc_id {dict(own.dtypes)['doc_id']}, n_words long, runs array<{run}>, best {run}, collapsed string")


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, "doc_id", "text", plant=True)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words")
