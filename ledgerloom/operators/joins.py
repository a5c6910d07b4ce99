"""Join helper: the OR-join rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_edges(pairs: DataFrame, a: str, b: str, out_a: str = "src",
                    out_b: str = "dst", drop_self: bool = True) -> DataFrame:
    """Turn undirected pairs into directed edges (a->b and b->a).

    ``x JOIN pairs ON pairs.a = x.id OR pairs.b = x.id`` plus
    ``... JOIN y ON (pairs.b = y.id OR pairs.a = y.id) AND x.id <> y.id``
    becomes two hash equi-joins on (src) and (dst) over this edge list."""
    fwd = pairs.select(F.col(a).alias(out_a), F.col(b).alias(out_b))
    rev = pairs.select(F.col(b).alias(out_a), F.col(a).alias(out_b))
    edges = fwd.unionByName(rev)
    if drop_self:
        edges = edges.where(F.col(out_a) != F.col(out_b))
    return edges
