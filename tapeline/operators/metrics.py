"""Metrics of scores and probabilities, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.exprs import average_rank, diagnostic_group, first_rank, safe_corr, safe_div
from tapeline.operators.order import quantiles, running
from tapeline.sinks.stored import stored


def binary_metrics(df: DataFrame, keys: list[str], probability: str = "probability", label: str = "label") -> DataFrame:
    """AUC by average ranks (null with one class), accuracy above one half, Brier score.

    Equal probabilities are counted as one row, whose average rank follows from the rows before it (operators.order).
    """
    y, p = F.col(label).cast("double"), F.col(probability).cast("double")
    one = df.select(*keys, y.alias("_y"), p.alias("_p")).where("_y is not null and _p is not null")
    right, square = ((F.col("_p") > 0.5).cast("double") == F.col("_y")).cast("double"), (F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))
    tally = one.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.sum("_y").alias("_y"), F.sum(right).alias("_right"), F.sum(square).alias("_square"))
    placed = running(tally, keys, ["_p"], ["_n"])
    n, n1 = F.sum("_n"), F.sum("_y")
    auc = safe_div(F.sum(F.col("_y") * (F.col("before__n") + (F.col("_n") + 1) / 2)) - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return placed.groupBy(*keys).agg(n.alias("n"), auc.alias("auc"), (F.sum("_right") / n).alias("accuracy"), (F.sum("_square") / n).alias("brier"))


def objective_metrics(df: DataFrame, score: str, label: str, target: str, beta: float = 1.0, ic_weight: float = 1.0) -> DataFrame:
    """Per date, then averaged: logistic loss, Huber loss, and Huber + weight * (1 - IC); the IC is 0 at a variance of 1e-8 or less."""
    s, y, t = F.col(score), F.col(label), F.col(target)
    d = F.abs(s - t)
    bce = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
    huber = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    ic = F.when((F.var_pop(s) > 1e-8) & (F.var_pop(t) > 1e-8), safe_div(F.covar_pop(s, t), F.stddev_pop(s) * F.stddev_pop(t))).otherwise(0.0)
    daily = df.groupBy("date").agg(F.avg(bce).alias("bce"), F.avg(huber).alias("huber"), ic.alias("ic"))
    return daily.agg(F.count("*").alias("n_dates"), F.avg("bce").alias("bce"), F.avg("huber").alias("huber"), F.avg(F.col("huber") + ic_weight * (1 - F.col("ic"))).alias("huber_ic"))


def signal_metrics(df: DataFrame, score: str = "score", ret: str = "future_ret", least: int = 10, groups: int = 10) -> DataFrame:
    """Over dates of ``least`` rows or more: mean IC and rank IC, share of positive ICs (null counts as not), decile correlation and violations."""
    w = Window.partitionBy("date")
    full = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    full = full.withColumns({"_a": average_rank(F.col(score), ["date"]), "_b": average_rank(F.col(ret), ["date"]), "_g": diagnostic_group(first_rank([F.col(score), F.col("code")], ["date"]), F.col("_n"), groups)})
    ic = full.groupBy("date").agg(safe_corr(F.col(score), F.col(ret)).alias("ic"), safe_corr(F.col("_a"), F.col("_b")).alias("rankic"))
    ic = ic.agg(F.count("*").alias("n_dates"), F.avg("ic").alias("ic_mean"), F.avg("rankic").alias("rankic_mean"), F.avg(F.coalesce(F.col("rankic") > 0, F.lit(False)).cast("double")).alias("rankic_positive_rate"))
    means = full.groupBy("_g").agg(F.avg(ret).alias("m"))
    means = means.withColumn("_step", F.col("m") - F.lag("m").over(Window.orderBy("_g")))  # ``groups`` rows
    means = means.agg(safe_corr(F.col("_g"), F.col("m")).alias("decile_corr"), F.sum((F.col("_step") < 0).cast("int")).alias("violations"))
    return ic.join(F.broadcast(means))


def probability_summary(df: DataFrame, keys: list[str], p: str = "probability") -> DataFrame:
    """Count, mean, population deviation, exact quantiles and the share above one half; one row for each group."""
    df = stored(df.select(*keys, F.col(p).alias("_x")))
    x = F.col("_x")
    simple = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg((x > 0.5).cast("double")).alias("positive_rate"))
    places = {f"p{int(q * 100):02d}": q for q in (0.01, 0.5, 0.99)}
    exact = quantiles(df, keys, "_x", places)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] or [F.lit(True)]
    return simple.alias("s").join(exact.alias("e"), same, "left").select(*[f"s.{k}" for k in keys], "s.n", "mean", "std", *places, "positive_rate")
