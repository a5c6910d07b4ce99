"""The corpus pipeline: quality rules, SimHash near-dedup, PII, mixing sources, best-fit packing.

Every stage works on all that the one before kept.  Stages but the last return the columns of ``documents``:
rejected and duplicate documents go, texts get surrogates, and a document that the mix takes twice is there
twice; the last stage returns the packed pieces.  A stage's edge cases are those of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, packing, pii, quality, simhash
from ledgerloom.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.stage(docs, table(spark, sf_dir, "labels"))),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.stage(docs)),
    ("pii_surrogates", lambda spark, docs, sf_dir: pii.stage(docs)),
    ("mix_sources", lambda spark, docs, sf_dir: mixing.stage(docs)),
    ("pack_sequences", lambda spark, docs, sf_dir: packing.stage(docs)),
]

ORACLE_SQL = None  # the stages cannot be stated in SQL; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
