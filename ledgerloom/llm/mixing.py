"""Operator 1, mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact length within their source.  A source's target is met by whole rounds of all
its documents and, for what is left, a set of documents whose lengths add up to the rest: the same share of
every length first, then a bounded-knapsack dynamic programme over the remaining budget.  The counts that
result say how many documents of each length get one more copy; a seeded hash order says which.

Edge cases: a null text has length 0; a null source is a source of its own, the last; documents of length 0
are taken as often as the whole rounds say; repeated rows are separate documents; a source without words has
target 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.row_id import dense_row_id
from .common import WORD, hash_id, staged

DP_BUDGET, DP_WORK = 4096, 100_000_000  # words that the dynamic programme settles at least; its work for few lengths
HASH_CELLS = 1024  # cells of the hash order of a (source, length) group


def subset_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each (distinct, positive) length to take so that the lengths' sum comes as
    near to ``budget`` as the programme finds.  Never more than ``counts``."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    limit = max(DP_BUDGET, min(1 << 22, DP_WORK // len(lengths)))  # words that the programme settles
    rest = budget
    if rest > limit:  # the same share of every length, then the longest that fit
        take = np.array([int(c) * budget // total for c in counts], np.int64)
        rest = budget - int((lengths * take).sum())
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= limit:
                break
            more = min(int(counts[i] - take[i]), (rest - limit) // int(lengths[i]) + 1, rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    over = rest + min(rest, DP_BUDGET)  # sums above the rest may come nearer
    fits = np.flatnonzero((lengths <= over) & (take < counts))
    if not len(fits):
        return take
    # bounded knapsack, counts split in powers of two: made[s] is the item that first reached the sum s
    made = np.full(over + 1, -1, np.int32)
    made[0] = 0
    items = []
    for i in fits:
        left, k = min(int(counts[i] - take[i]), over // int(lengths[i])), 1
        while left:
            k = min(k, left)
            size = k * int(lengths[i])
            items.append((i, k, size))
            new = (made[:over + 1 - size] >= 0) & (made[size:] < 0)
            made[size:][new] = len(items)
            left, k = left - k, 2 * k
        if made[rest] >= 0:
            break
    reached = np.flatnonzero(made >= 0)
    at = int(reached[np.argmin(np.abs(reached - rest))])
    while at:
        i, k, size = items[made[at] - 1]
        take[i] += k
        at -= size
    return take


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weights repeat over the sources by code point, null
    last; targets add up to ``share`` of all words, none above ``most`` times its source's words, the excess
    reshared by weight until none is.  Each round is one aggregation; two numbers reach the driver."""
    ranked = dense_row_id(sizes, [F.col("source").asc_nulls_last()], "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", pick.alias("weight")), "mix-sources")
    whole = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    limit, level = F.col("source_size") * most, 0.0
    while True:
        full = limit < F.col("weight") * level
        got = ranked.agg(F.sum(F.when(full, limit)).alias("capped"),
                         F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = (whole - (got["capped"] or 0)) / got["weight"] if got["weight"] else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def n_words(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def mix_copies(df: DataFrame, id_col: str, size: Column, source_col: str, weights: Sequence[float] = (5, 2, 1),
               share: float = 1.0, most: int = 3, seed: int = 29) -> DataFrame:
    """Return ``record`` (the whole input row), ``size``, ``source_size``, ``target`` and ``copies``."""
    # sources as keys without nulls, in the same order: one partitioning then serves the join and the window
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    sized = df.select(F.struct("*").alias("record"), F.col(id_col).alias("id"), key.alias("source"), size.alias("size"))
    sized = sized.withColumn("order", hash_id("id", seed=seed))
    cell = F.pmod(F.shiftrightunsigned("order", 40), F.lit(HASH_CELLS)).alias("cell")
    counted = staged(sized.groupBy("source", "size", cell).agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    by_length = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = staged(targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                          weights, share, most), "mix-targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source: a row for each of its distinct lengths."""
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        whole, target = int((size * n).sum()), float(pdf["target"].iloc[0])
        rounds = min(int(target // whole), most) if whole else 0
        used, extra = size > 0, np.zeros(len(size), np.int64)
        if rounds < most:
            extra[used] = subset_counts(size[used], n[used], int(round(target - rounds * whole)))
        return pdf.assign(rounds=rounds, extra=extra)[["source", "size", "source_size", "target", "rounds", "extra"]]

    # a source's lengths come sorted, so that reruns agree
    fitted = staged(by_length.join(goal, "source").groupBy("source").applyInPandas(
        lambda pdf: fit(pdf.sort_values("size")),
        "source string, size long, source_size long, target double, rounds long, extra long"), "mix-fit")
    # how many documents of each cell of the hash order get the extra copy
    before = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .join(fitted, ["source", "size"])
             .select("source", "size", "cell", "source_size", "target", "rounds",
                     F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("cut")))
    place = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("order", "id"))
    copies = F.col("rounds") + F.when(place <= F.col("cut"), 1).otherwise(0)
    return (sized.withColumn("cell", cell).join(cells, ["source", "size", "cell"])
            .select("record", "size", "source_size", "target", copies.cast("int").alias("copies")))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest.  Only ids, sources and word counts travel."""
    own = docs.select("doc_id", "source", n_words("text").alias("n"))
    mixed = mix_copies(own, "doc_id", F.col("n"), "source")
    return mixed.select("record.doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    mixed = mix_copies(docs, "doc_id", n_words("text"), "source")
    return (mixed.filter("copies > 0")
            .select("record", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
            .select("record.*"))
