"""The registered queries of this subpackage: key -> f(spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontamination, mixing, neighbours, packing, pii, ppm, quality, runs, secrets, sharding, simhash, suffixes,
               whitening)
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {
    "op1_mix_sources": lambda spark, d: mixing.op1(table(spark, d, "documents")),
    "op2_repeated_passages": lambda spark, d: suffixes.op2(table(spark, d, "documents")),
    "op3_secret_scan": lambda spark, d: secrets.op3(table(spark, d, "documents")),
    "op4_quality_rules": lambda spark, d: quality.op4(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_external_shuffle": lambda spark, d: sharding.op5(table(spark, d, "documents")),
    "op6_pack_sequences": lambda spark, d: packing.op6(table(spark, d, "documents")),
    "op7_ppm_scores": lambda spark, d: ppm.op7(table(spark, d, "documents")),
    "op8_simhash_groups": lambda spark, d: simhash.op8(table(spark, d, "documents")),
    "op9_hilbert_neighbours": lambda spark, d: neighbours.op9(table(spark, d, "embeddings")),
    "op10_surrogates": lambda spark, d: pii.op10(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: runs.op11(table(spark, d, "documents")),
    "op12_whitening": lambda spark, d: whitening.op12(table(spark, d, "embeddings")),
    "op13_benchmark_windows": lambda spark, d: decontamination.op13(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLE_SQL: dict[str, str] = {"op13_benchmark_windows": decontamination.OP13_SQL}
