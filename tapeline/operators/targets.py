"""Training targets, splits and folds. Positions on a calendar come from its distinct dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.functions.exprs import safe_div


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with their positions from 0 (a few thousand rows, whatever the panel's size)."""
    return df.select(F.col(date).alias("date")).where("date is not null").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def purge_cutoff(dates: DataFrame, before: Column, gap: int) -> DataFrame:
    """One row, ``cutoff``: the gap-th last distinct date before the boundary; null if there aren't more than ``gap``."""
    ranked = dates.select("date").where(F.col("date") < before).distinct().withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))))
    return ranked.agg(F.max(F.when(F.col("_k") == gap, F.col("date"))).alias("cutoff"), F.count("*").alias("n")).select(F.when(F.col("n") > gap, F.col("cutoff")).alias("cutoff"))


def fixed_split(sample: DataFrame, horizon: int, cfg: EngineConfig, dates: DataFrame | None = None) -> DataFrame:
    """split: train, valid or test; ``max(horizon, embargo)`` dates before either boundary belong to none. Dates are those of the sample.

    ``dates``: the sample's distinct dates, where they are at hand; otherwise the sample is worked out once more for each boundary.
    """
    dates = sample if dates is None else dates
    gap = max(horizon, cfg.embargo.get(horizon, 0))
    a = purge_cutoff(dates, F.lit(cfg.valid_start), gap).select(F.col("cutoff").alias("_train"))
    b = purge_cutoff(dates, F.lit(cfg.test_start), gap).select(F.col("cutoff").alias("_valid"))
    d = F.col("date")
    split = F.when((d <= F.lit(cfg.train_end)) & (d < F.col("_train")), "train").when(d.between(F.lit(cfg.valid_start), F.lit(cfg.valid_end)) & (d < F.col("_valid")), "valid").when(d >= F.lit(cfg.test_start), "test")
    return sample.join(F.broadcast(a)).join(F.broadcast(b)).withColumn("split", split).drop("_train", "_valid")


def fold_ranges(cal: DataFrame, folds: int) -> DataFrame:
    """fold (from 0), first and last date and position of contiguous folds; the first ones are a date longer."""
    w = Window.orderBy("date")
    return cal.withColumn("fold", (F.ntile(folds).over(w) - 1).cast("int")).groupBy("fold").agg(F.min("date").alias("fold_start"), F.max("date").alias("fold_end"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_dates"))


def purged_folds(sample: DataFrame, cal: DataFrame, cfg: EngineConfig, purge: int | None = None) -> DataFrame:
    """Each row once for each fold with its split: valid in the fold, none within ``purge`` dates of it, test from the test start on, else train.

    The folds divide the calendar before the test start.
    """
    purge = cfg.purge_days if purge is None else purge
    ranges = fold_ranges(cal.where(F.col("date") < F.lit(cfg.test_start)), cfg.folds).select("fold", "start_pos", "end_pos")
    days = F.broadcast(cal).join(F.broadcast(ranges))
    p = F.col("pos")
    split = F.when(F.col("date") >= F.lit(cfg.test_start), "test").when(p.between(F.col("start_pos"), F.col("end_pos")), "valid").when(p.between(F.col("start_pos") - purge, F.col("end_pos") + purge), None).otherwise("train")
    return sample.join(F.broadcast(days.select("date", "fold", split.alias("split"))), "date")


def edge_dates(df: DataFrame, n: int, last: bool = False) -> DataFrame:
    """Rows of the first (or last) n dates."""
    w = Window.orderBy(F.desc("date") if last else F.asc("date"))
    days = df.select("date").distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select("date")
    return df.join(F.broadcast(days), "date", "left_semi")


def winsor_target(df: DataFrame, value: str = "future_ret", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``target``: the value clipped to its date's quantiles, then standardised by mean and population deviation (0 without deviation)."""
    w = Window.partitionBy("date")
    x = F.col(value).cast("double")
    df = df.withColumns({"_lo": F.percentile(x, F.lit(low)).over(w), "_hi": F.percentile(x, F.lit(high)).over(w)})
    df = df.withColumn("_x", F.greatest(F.least(x, F.col("_hi")), F.col("_lo")))
    sd = F.stddev_pop("_x").over(w)
    df = df.withColumn("target", F.when(F.col("_x").isNotNull(), F.coalesce(safe_div(F.col("_x") - F.avg("_x").over(w), F.when(sd > 0, sd)), F.lit(0.0))))
    return df.drop("_lo", "_hi", "_x")


def member_zscore(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """``z``: the score standardised within ``keys`` by the population deviation; null where that is 1e-12 or less."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(score).over(w)
    return df.withColumn("z", safe_div(F.col(score) - F.avg(score).over(w), F.when(sd > 1e-12, sd)))


def degenerate_members(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Groups whose scores can't be standardised."""
    bad = F.max((F.col(score).isNull() | F.isnan(score)).cast("int")) == 1
    return df.groupBy(*keys).agg(F.stddev_pop(score).alias("sd"), bad.alias("has_missing")).where("has_missing or sd <= 1e-12 or sd is null")


def ensemble(members: DataFrame, expected: int | None = None, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """Mean of the members' z and probability for each key; with ``expected``, only keys of all members."""
    out = members.groupBy(*keys).agg(F.avg("z").alias("pred_score"), F.avg("probability").alias("pred_probability_mean"), F.count("*").alias("ensemble_member_count"))
    return out.where(F.col("ensemble_member_count") == expected) if expected else out
