"""Reading tables, and cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else the context's.

    Where neither is set, a temporary folder serves a local master; on a cluster that would not be shared, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tracklake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[str] = []
_within: ContextVar[tuple[list[str], ...]] = ContextVar("within", default=())
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """What runs within deletes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: survives lost executors, ends lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    for paths in (_written, *_within.get()):
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written by `cut`; the tables that it wrote on the way are deleted then."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        token = _within.set((*_within.get(), own := []))
        try:
            out = operator(*args, **kwargs)
        finally:
            _within.reset(token)
        result = cut(out)
        remove(out.sparkSession, own)
        _written[:] = [x for x in _written if x not in own]
        return result

    return run


def clear(spark: SparkSession) -> int:
    """Deletes the tables that `cut` has written so far in this process; results that still read them must be done with."""
    paths, _written[:] = list(_written), []
    remove(spark, paths)
    return len(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of any file system that Spark reads; those that aren't there are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
