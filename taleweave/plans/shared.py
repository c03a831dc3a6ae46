"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset and everything runs in this
process, as in local tests, a folder of this process is used and entered into the session's configuration.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not d:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="taleweave-")
        spark.conf.set(_KEY, d)
    return d.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the plan above starts from
    files that survive the loss of any executor. The files go with ``clear`` or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taleweave-{name}-{uuid.uuid4().hex}"
    _write(df.write, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Once a table is written, what was shuffled for it goes at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _written.append((spark, path))


def written() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(since: int, *kept: DataFrame) -> None:
    """Delete the tables written since the mark, but for ``kept`` ones: nothing may read the others any more."""
    stay = [f for df in kept for f in df.inputFiles()]
    for spark, path in _written[since:]:
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in stay):
            drop(path, spark)
            _written.remove((spark, path))


def cut_parts(df: DataFrame, by: list[str], name: str = "stage") -> list[str]:
    """As ``cut``, with a file for each value of ``by`` in each part of ``df``, whose rows are sorted by it;
    gives the files, which are named by the part's number."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taleweave-{name}-{uuid.uuid4().hex}"
    _write(df.write.option("maxRecordsPerFile", 0).partitionBy(*by), spark, path)
    return sorted(spark.read.schema(df.schema).parquet(path).inputFiles())


def _at(path: str, spark: SparkSession) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str, spark: SparkSession) -> bool:
    where, p = _at(path, spark)
    return where.exists(p)


def drop(path: str, spark: SparkSession) -> None:
    where, p = _at(path, spark)
    where.delete(p, True)


@atexit.register
def clear() -> None:
    """Delete all tables that ``cut`` has written so far: for long sessions, once their results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            drop(path, spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
