"""Helpers on Spark: cut lineage in the shared folder, stream over runs of equal keys, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only for a local master without it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it is deleted when the driver ends, as results are read from it until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()

    def clean() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            at.getFileSystem(conf).delete(at, True)

    atexit.register(clean)
    return path


class Scratch:
    """Tables written once into the shared folder: what follows reads them, not their lineage, also after an executor is lost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_path(spark, "scratch")
        self.made: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "lz4_raw").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of which nothing more will be read."""
        for df in tables:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.made.pop(id(df)))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns as c0, c1, ..., and the new name of each: no column of the input clashes with a helper's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def small_enough(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def joined(left: DataFrame, right: DataFrame, rows: int, row_bytes: int, on: list[str], how: str) -> DataFrame:
    """Join with a right side of known size: broadcast up to BROADCAST_BYTES, else by a shuffle."""
    return left.join(F.broadcast(right) if small_enough(rows, row_bytes) else right, on, how)


def by_runs(df: DataFrame, key: str, order: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over batches in which equal keys follow each other, sorted by ``order`` within a key."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(fn, schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (u, v: long): rows (node, root), root the smallest node, one for each node but the roots.

    Alternating large-star and small-star steps; each round is written to the shared folder. A hub
    meets its neighbours through a partial minimum and a join that Spark may split, never in a list.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        then = scratch.table(small)
        found = then.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(now)
        now = then
        if mark == tuple(found):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)


class Carry:
    """Batches of sorted rows cut so that each part ends where a key ends, but for keys longer than ``most`` rows."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.rest: list[np.ndarray] | None = None

    def whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns]
            if self.rest is not None:
                cols = [np.concatenate(x) for x in zip(self.rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            self.rest = [c[cut:] for c in cols]
            if cut:
                yield [c[:cut] for c in cols]
        if self.rest is not None and len(self.rest[0]):
            yield self.rest


def repeated(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int = 1) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of rows sorted by all ``columns`` (the first ``keys`` are the key), those whose key has two distinct rows at least, each distinct row once.

    Yields the columns and, for each row, how many rows its key has shown so far (to the batch's
    end). One row is all that is kept from batch to batch, however long a run of one key is.
    """
    pending, last, open_key, seen = None, None, None, 0
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        if last is not None:
            new[0] = any(c[0] != x for c, x in zip(cols, last, strict=True))
        last = [c[-1] for c in cols]
        cols = [c[new] for c in cols]
        if pending is not None:
            cols = [np.concatenate([p, c]) for p, c in zip(pending, cols, strict=True)]
            pending = None
        key = cols[:keys]
        if not len(key[0]):
            continue
        same = np.zeros(len(key[0]) + 1, dtype=bool)
        same[1:-1] = np.logical_and.reduce([k[1:] == k[:-1] for k in key])
        same[0] = open_key is not None and all(k[0] == x for k, x in zip(key, open_key, strict=True))
        keep = same[:-1] | same[1:]
        first = np.flatnonzero(~same[:-1])
        run = np.cumsum(~same[:-1]) - (0 if same[0] else 1)
        sizes = np.diff(np.append(first if not same[0] else np.append(0, first), len(key[0])))
        if same[0]:
            sizes[0] += seen
        if not keep[-1]:
            pending = [c[-1:] for c in cols]
            open_key, seen = None, 0
        else:
            open_key, seen = [k[-1] for k in key], int(sizes[-1])
        if keep.any():
            yield [c[keep] for c in cols], sizes[run][keep]
