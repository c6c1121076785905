"""Stored tables: partitions, required columns, predictions, daily rows, members."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import Experiment
from tapeline.operators.cross_section import predictions
from tapeline.schema import DAILY, PREDICTION, require_columns


def read_partitioned(spark: SparkSession, path: str, columns: list[str] | None = None, codes: list[str] | None = None, years: range | None = None) -> DataFrame:
    """A table by code, bucket or year. Codes keep their zeros: the session must not infer partition types (session.SETTINGS)."""
    df = spark.read.parquet(path)
    if codes is not None:
        df = df.where(F.col("code").isin(codes))
    if years is not None:
        df = df.where(F.col("year").between(years.start, years.stop - 1))
    return df.select(*require_columns(df, columns, path).select(*columns).columns) if columns else df


def training_columns(experiments: tuple[Experiment, ...], features: list[str]) -> list[str]:
    """What the experiments need of a feature table."""
    own = [f"{p}_{e.horizon}d" for e in experiments for p in ("label", "future_ret")]
    return list(dict.fromkeys(["date", "code", "is_tradable", *features, *own]))


def read_predictions(spark: SparkSession, root: str, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """Prediction tables of a folder in their common form; an empty result is an error."""
    df = predictions(require_columns(read_tables(spark, root, pattern, most), PREDICTION, "predictions"))
    if not df.head(1):
        raise ValueError(f"no usable prediction in {root}")
    return df


def read_tables(spark: SparkSession, root: str, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """All prediction tables directly under ``root`` as one, columns that some lack null; ``most`` keeps the first ones by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(x.getPath().toString() for x in fs.globStatus(at(f"{root}/{pattern or '*'}")) if not x.getPath().getName().startswith((".", "_")))[:most]
    if not found:
        raise ValueError(f"no prediction table under {root} by the pattern {pattern or '*'}")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in found])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def earliest_date(pred: DataFrame) -> dt.date | None:
    return pred.agg(F.min("date")).first()[0]


def read_daily(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """Execution columns from ``since`` on (the filter reaches the scan), flags never null."""
    df = require_columns(spark.read.parquet(path), DAILY, "daily rows")
    if since:
        df = df.where(F.col("date") >= F.lit(since))
    flags = [c for c in DAILY if c.startswith("is_")]
    return df.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in flags else F.col(c) for c in DAILY]).dropna(subset=["date", "code"])


def read_members(spark: SparkSession, path: str, loss: str, experiment: str, folds: int = 5, seeds: int = 4) -> DataFrame:
    """Member predictions of one loss and experiment, partitioned by fold and seed; all folds x seeds must be there."""
    df = spark.read.parquet(path).where((F.col("loss") == loss) & (F.col("experiment") == experiment))
    found = df.select("fold", "seed").distinct().count()
    if found != folds * seeds:
        raise ValueError(f"{loss}/{experiment}: {found} members, not {folds * seeds}")
    return df
