"""Cutting lineage through tables written to the cluster's shared folder.

Iterative operators read their intermediate result more than once. They write
it as Parquet below ``spark.checkpoint.dir`` (shared by all executors, so a
lost executor costs nothing) and read it back. Only where that setting is
absent, as in local tests, a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a machine-local one is allowed on a local master only."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="sievelake-")
    return _local_root


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block belong to it and are deleted when it ends, so a long session does not fill the shared folder."""
    before = len(_written)
    try:
        yield
    finally:
        mine, _written[before:] = [x for x in _written[before:]], []
        for owner, path in mine:
            _delete(owner, path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that are read no more; frames that are none are passed over."""
    paths = {f._staged for f in frames if hasattr(f, "_staged")}
    for owner, path in [x for x in _written if x[1] in paths]:
        _delete(owner, path)
    _written[:] = [x for x in _written if x[1] not in paths]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session; their DataFrames are unusable afterwards."""
    mine = [path for owner, path in _written if owner is spark]
    _written[:] = [x for x in _written if x[0] is not spark]
    for path in mine:
        _delete(spark, path)


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(_release_all)
