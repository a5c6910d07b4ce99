"""Committed tables (A4): data is written aside, then a manifest makes it the table's content.

A table is a folder with version folders and numbered manifests.  A manifest names, for every partition
directory, the version folders that hold its rows; the highest number is the table.  A write that fails
leaves folders no manifest names, so readers go on with what was there; a commit repeated under the same
``commit_id`` changes nothing.  Partitions are replaced one by one: those of the new data (or those named)
point to the new version, all others stay with their files.  The manifest holds one entry for each partition,
never file lists; two writers that start from the same manifest cannot both succeed where the file system's
rename refuses an existing target (object stores need their own lock).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class CommitConflict(RuntimeError):
    """Another commit was made from the same manifest."""


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    schema: dict | None = None
    partition_by: tuple[str, ...] = ()
    parts: dict[str, list[str]] = field(default_factory=dict)  # partition directory ('' when none) -> version folders
    commits: tuple[str, ...] = ()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path), _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, path: str) -> Manifest:
    """The table's manifest; an empty one (number 0) before the first commit."""
    names = [n for n in _children(spark, f"{path}/{MANIFESTS}") if n.endswith(".json")]
    if not names:
        return Manifest()
    stream = _fs(spark, path).open(_path(spark, f"{path}/{MANIFESTS}/{max(names)}"))
    try:
        d = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(d["number"], d["schema"], tuple(d["partition_by"]), d["parts"], tuple(d["commits"]))


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    fs = _fs(spark, path)
    final, aside = _path(spark, f"{path}/{MANIFESTS}/{m.number:010d}.json"), _path(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(m.__dict__).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise CommitConflict(f"{path}: manifest {m.number} exists")


def _directories(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition directories ``a=1/b=2`` under ``path``."""
    if depth == 0:
        return [""]
    out = []
    for name in _children(spark, path):
        if "=" in name:
            out += [f"{name}/{d}" if d else name for d in _directories(spark, f"{path}/{name}", depth - 1)]
    return out


def commit(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "replace",
           replacing: Iterable[str] | None = None, commit_id: str | None = None) -> Manifest:
    """Write ``df`` and make it part of the table: ``replace`` the whole table, ``partitions`` (those of the new
    data, and those named in ``replacing``) or ``append``."""
    if mode not in ("replace", "partitions", "append"):
        raise ValueError("mode must be replace, partitions or append")
    spark, partition_by, before = df.sparkSession, tuple(partition_by), current(df.sparkSession, path)
    if commit_id is not None and commit_id in before.commits:
        return before
    if before.number and mode != "replace" and before.partition_by != partition_by:
        raise ValueError(f"{path} is partitioned by {before.partition_by}")
    version = f"v{before.number + 1}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    new = _directories(spark, f"{path}/{version}", len(partition_by))
    parts = {} if mode == "replace" else {k: list(v) for k, v in before.parts.items()}
    if mode == "partitions":
        parts = {k: v for k, v in parts.items() if k not in {*new, *(replacing or ())}}
    for d in new:
        parts[d] = [*parts.get(d, []), version]
    after = Manifest(before.number + 1, json.loads(df.schema.json()), partition_by, parts, (*before.commits, commit_id or version)[-1000:])
    _publish(spark, path, after)
    return after


def read_committed(spark: SparkSession, path: str, partitions: Iterable[str] | None = None) -> DataFrame:
    """The table's rows, or those of some partition directories (``'bucket=3'``).  One scan for each version that
    is still referred to."""
    m = current(spark, path)
    if not m.number:
        raise FileNotFoundError(f"{path}: nothing committed")
    schema = StructType.fromJson(m.schema)
    wanted = m.parts if partitions is None else {p: m.parts[p] for p in partitions if p in m.parts}
    by_version: dict[str, list[str]] = {}
    for part, versions in wanted.items():
        for v in versions:
            by_version.setdefault(v, []).append(f"{path}/{v}/{part}".rstrip("/"))
    out = spark.createDataFrame([], schema)
    for i, (v, dirs) in enumerate(sorted(by_version.items())):
        some = spark.read.schema(schema).option("basePath", f"{path}/{v}").parquet(*dirs).select(*schema.names)
        out = out.unionByName(some) if i else some
    return out


def expire(spark: SparkSession, path: str) -> list[str]:
    """Delete version folders that the current manifest does not refer to (after failed or replaced writes, and
    when no reader is left on an older manifest)."""
    live = {v for versions in current(spark, path).parts.values() for v in versions}
    gone = [n for n in _children(spark, path) if n.startswith("v") and n not in live]
    for n in gone:
        _fs(spark, path).delete(_path(spark, f"{path}/{n}"), True)
    return gone
