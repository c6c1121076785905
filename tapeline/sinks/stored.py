"""Steps that several branches of a plan read, written once into the shared folder.

What follows plans and reads a small table in place of the step's whole lineage, with the columns it needs only, and
an executor's loss costs nothing that was written. Writing a step runs a job, so functions that use steps run jobs
when they are called, before their result is asked for.

A step belongs to the innermost ``Steps`` that is open where it is made, and goes when that one is closed; steps made
outside any stay until the driver ends. So a stage that has written its results deletes its own steps and no others.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir, which all executors share; one temporary folder only for a local master without it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at and (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        at = known.get()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="steps-"))
    return _LOCAL[0]


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Steps:
    """Owner of the steps that are made while it is open: ``with Steps(): ...`` deletes them, and only them, at its end."""

    def __init__(self) -> None:
        self.kept: list[tuple[SparkSession, str]] = []

    def close(self) -> None:
        while self.kept:
            delete(*self.kept.pop())

    def __enter__(self) -> Steps:
        self._outer = _OPEN.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._outer)
        self.close()


_ALL = Steps()
_OPEN: ContextVar[Steps] = ContextVar("steps", default=_ALL)
atexit.register(_ALL.close)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again; the table stays until its owner closes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    _OPEN.get().kept.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
