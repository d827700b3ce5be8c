"""Where intermediate tables go, and how they go away again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables of the job at hand; None outside of jobs.
_MADE: ContextVar[set[str] | None] = ContextVar("made", default=None)


def qualified(spark: SparkSession, path: str) -> str:
    """path as Hadoop's file systems, and so Spark, understand it, with its scheme: what a library of another kind must be
    given to find the same files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the one in spark.checkpoint.dir; only a local
    session without that setting gets a temporary folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stallmap-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: cuts the lineage, and survives the loss of any
    executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.add(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if (made := _MADE.get()) is not None:
        made.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more, such as those of a loop's last round."""
    for t in tables:
        if path := t.__dict__.get("stored_at"):
            _delete(t.sparkSession, path)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Within it, tables of materialize() belong to this job, and are deleted at its end, also after an error: its results must be
    stored by then. Tables of other jobs, of a job around it, and of other threads stay."""
    before, made = _MADE.get(), set()
    _MADE.set(made)
    try:
        yield
    finally:
        for path in list(made):
            _delete(spark, path)
        _MADE.set(before)
