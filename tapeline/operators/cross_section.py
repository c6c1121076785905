"""Cross-sections: universes, deciles, information coefficients and their summaries, per date and group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.exprs import average_rank, first_rank, quantile_group, safe_corr, safe_div

GROUP = ["experiment_name", "model_name", "universe_group"]
PERIOD = ["date", *GROUP]
MODEL_PERIOD = ["date", "experiment_name", "model_name"]


def predictions(df: DataFrame) -> DataFrame:
    """Common form of a prediction table: pred_score or else pred_prob is the score; incomplete rows go."""
    names = [c for c in ("pred_score", "pred_prob") if c in df.columns]
    if not names:
        raise ValueError("predictions: neither pred_score nor pred_prob")
    df = df.withColumn("score", F.col(names[0]).cast("double"))
    return df.dropna(subset=["date", "code", "score", "future_ret", "horizon"])


#: Rows of predictions of a task, as far as periods allow: a period of one model isn't divided.
TASK_ROWS = 1 << 16


def dealt(pred: DataFrame, rows: int) -> DataFrame:
    """``pred`` of about ``rows`` rows by period and model, over more partitions the more rows there are.

    What follows ranks within periods and stays in these partitions. Over a fixed number of them a task would sort ever more periods.
    """
    n = -(-rows // TASK_ROWS)
    return pred.repartition(n, "date", "experiment_name", "model_name") if n > int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pred


def universes(pred: DataFrame) -> DataFrame:
    """Each row as ``all``; rows with a market value also as large_cap (upper third by rank) or small_mid_cap."""
    return _sized(pred).withColumn("universe_group", F.explode(F.array_compact(F.array(F.lit("all"), F.col("_size"))))).drop("_size")


SIZES = ("large_cap", "small_mid_cap")


def _sized(pred: DataFrame) -> DataFrame:
    """``pred`` with _size: large_cap, small_mid_cap or null. Rank and count come from one sorted window."""
    order = Window.partitionBy(*MODEL_PERIOD).orderBy(F.col("float_mktcap").asc_nulls_last(), "code")
    share = F.row_number().over(order) / F.count("float_mktcap").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return pred.withColumn("_size", F.when(F.col("float_mktcap").isNotNull(), F.when(share > 2 / 3, SIZES[0]).otherwise(SIZES[1])))


def universe_sizes(pred: DataFrame) -> DataFrame:
    """n, the rows of each period of ``universes``, by counts alone: of v rows with a market value, small_mid_cap are the floor(2 v / 3) first."""
    df = pred.groupBy(*MODEL_PERIOD).agg(F.count("*").alias("_all"), F.count("float_mktcap").alias("_v"))
    small = F.expr("_v * 2 div 3")
    sizes = [F.struct(F.lit(name).alias("universe_group"), n.alias("n")) for name, n in (("all", F.col("_all")), (SIZES[0], F.col("_v") - small), (SIZES[1], small))]
    return df.select(*MODEL_PERIOD, F.inline(F.array(*sizes))).where("n > 0")


def universe_deciles(pred: DataFrame, groups: int = 10) -> DataFrame:
    """``deciles`` of ``universes`` by one sort of the scores: a row's rank in its size class is a running count, so rows are repeated after they were ranked."""
    df = _sized(pred)
    order = Window.partitionBy(*MODEL_PERIOD).orderBy("score", "code")
    so_far, whole = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    counted = {"": F.lit(1)} | {s: F.when(F.col("_size") == s, 1) for s in SIZES}
    df = df.withColumns({f"_{k}{s}": F.count(c).over(w) for s, c in counted.items() for k, w in (("r", so_far), ("n", whole))})
    own = lambda k: F.when(F.col("_size") == SIZES[0], F.col(f"_{k}{SIZES[0]}")).otherwise(F.col(f"_{k}{SIZES[1]}"))
    both = [F.struct(name.alias("universe_group"), r.alias("_r"), n.alias("_n")) for name, r, n in ((F.lit("all"), F.col("_r"), F.col("_n")), (F.col("_size"), own("r"), own("n")))]
    df = df.select(*pred.columns, F.inline(F.filter(F.array(*both), lambda x: x["universe_group"].isNotNull())))
    return df.withColumn("decile", quantile_group(F.col("_r"), F.col("_n"), groups)).drop("_r", "_n")


def array_deciles(pred: DataFrame, rows: int, groups: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``universe_deciles`` of about ``rows`` rows: a task ranks its periods by array sorts, size classes and deciles of both universes at once, and rows are repeated after that.

    ``keep``: the columns of ``pred`` that are asked for (default: all).
    """
    spark = pred.sparkSession
    own = [F.col(c).cast("double").alias(c) if c in ("float_mktcap", "score") else F.col(c) for c in pred.columns]
    ranks = "_size string, _all int, _own int"
    keep = pred.columns if keep is None else keep
    schema = pred.select(*[c for c, name in zip(own, pred.columns) if name in keep]).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ranks.split(", ")}).schema

    def ranked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        batches = list(batches)  # some periods of one model each, for more rows more tasks
        table = pa.Table.from_batches(batches).combine_chunks() if batches else None
        if not table or not table.num_rows:
            return
        n = table.num_rows
        column = lambda c: table.column(c).combine_chunks()

        def place(c):
            """Places of a column's values in order of their texts."""
            text = column(c).cast(pa.string()).fill_null("").dictionary_encode()
            return np.unique(np.asarray(text.dictionary).astype(str), return_inverse=True)[1][np.asarray(text.indices)]

        code = place("code")
        period = np.zeros(n, np.int64)
        for c in MODEL_PERIOD:
            known = np.asarray(column(c).is_valid())
            value = place(c)
            period = np.unique(period * 2 * (int(value.max()) + 1) + value * 2 + known, return_inverse=True)[1]

        def rank(inside, by):
            """Place from 1 within ``inside`` in order of ``by`` and the number of its rows."""
            order = np.lexsort((code, *by, inside))
            counts = np.bincount(inside)
            out = np.empty(n, np.int64)
            out[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            return out, counts[inside]

        def group(r, size):
            out = np.ones(n, np.int32)
            for k in range(1, groups):
                out += r > 1 + k / groups * (size - 1)
            return pa.array(out, mask=size < groups)

        none = np.asarray(column("float_mktcap").is_null())
        cap, _ = rank(period, (np.asarray(column("float_mktcap").fill_null(0.0)), none))
        large = cap / np.maximum(np.bincount(period, weights=~none)[period], 1) > 2 / 3
        score = np.asarray(column("score").fill_null(-np.inf))
        unknown = ~np.asarray(column("score").is_null())
        every = rank(period, (score, unknown))
        kind = np.where(none, 2, np.where(large, 0, 1))
        each = rank(np.unique(period * 3 + kind, return_inverse=True)[1], (score, unknown))
        size = pa.DictionaryArray.from_arrays(pa.array(np.minimum(kind, 1).astype(np.int32), mask=none), pa.array(SIZES)).cast(pa.string())
        table = table.select([c for c in table.column_names if c in keep]).append_column("_size", size).append_column("_all", group(*every)).append_column("_own", group(*each))
        yield from table.to_batches(max_chunksize=10_000)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = pred.repartition(max(n, -(-rows // TASK_ROWS)), *MODEL_PERIOD)
    df = df.select(*own).mapInArrow(ranked, schema)
    both = [F.struct(name.alias("universe_group"), d.alias("decile")) for name, d in ((F.lit("all"), F.col("_all")), (F.col("_size"), F.col("_own")))]
    return df.select(*keep, F.inline(F.array(*both))).where("universe_group is not null")


def deciles(pred: DataFrame, groups: int = 10) -> DataFrame:
    """decile of the score within period and group, ties by code; null in groups of fewer rows than deciles."""
    rank = first_rank([F.col("score"), F.col("code")], PERIOD)
    return pred.withColumn("decile", quantile_group(rank, F.count("*").over(Window.partitionBy(*PERIOD)), groups))


def ic_by_period(pred: DataFrame) -> DataFrame:
    """num_stocks, ic (Pearson) and rankic (Pearson of average ranks) for each period."""
    ranked = pred.withColumns({"_r": average_rank(F.col("score"), PERIOD), "_q": average_rank(F.col("future_ret"), PERIOD)})
    return ranked.groupBy(*PERIOD).agg(F.count("*").alias("num_stocks"), safe_corr(F.col("score"), F.col("future_ret")).alias("ic"), safe_corr(F.col("_r"), F.col("_q")).alias("rankic"))


def summary_of(c: str, prefix: str) -> list[Column]:
    """Count, mean, deviation, information ratio, t-statistic and positive rate of a column, as aggregates."""
    x = F.col(c)
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    ratio = safe_div(mean, F.when(sd > 0, sd))
    positive = F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))
    return [n.alias(f"n_{prefix}"), mean.alias(f"{prefix}_mean"), sd.alias(f"{prefix}_std"), ratio.alias(f"{prefix}ir"), (ratio * F.sqrt(n.cast("double"))).alias(f"{prefix}_t_stat"), positive.alias(f"{prefix}_positive_rate")]


def ic_summary(ic: DataFrame) -> DataFrame:
    return ic.groupBy(*GROUP).agg(F.count("*").alias("n_periods"), *summary_of("ic", "ic"), *summary_of("rankic", "rankic"))


def cumulative_ic(ic: DataFrame) -> DataFrame:
    w = Window.partitionBy(*GROUP).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ic.withColumns({f"cumulative_{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(w) for c in ("ic", "rankic")})


def decile_returns(pred: DataFrame) -> DataFrame:
    """Mean and median future return, mean score and number of stocks for each period and decile."""
    out = pred.where("decile is not null").groupBy(*PERIOD, "decile").agg(F.avg("future_ret").alias("mean_future_ret"), F.median("future_ret").alias("median_future_ret"), F.avg("score").alias("avg_pred_prob"), F.count("code").alias("num_stocks"))
    return out.withColumn("portfolio_name", F.concat(F.lit("D"), F.col("decile").cast("string")))


def decile_summary(returns: DataFrame) -> DataFrame:
    return returns.groupBy(*GROUP, "decile", "portfolio_name").agg(
        F.count("*").alias("n_periods"), F.avg("mean_future_ret").alias("mean_future_ret"), F.stddev_samp("mean_future_ret").alias("std_period_future_ret"),
        F.median("median_future_ret").alias("median_period_future_ret"), F.avg("avg_pred_prob").alias("avg_pred_prob"), F.avg("num_stocks").alias("avg_num_stocks"),
    )


def monotonicity(summary: DataFrame) -> DataFrame:
    """Rank correlation of decile and mean return, monotonic flags and adjacent violations; under two deciles null, false, false, null."""
    df = summary.where("mean_future_ret is not null").withColumn("_step", F.col("mean_future_ret") - F.lag("mean_future_ret").over(Window.partitionBy(*GROUP).orderBy("decile")))
    df = df.withColumns({"_r": average_rank(F.col("mean_future_ret"), GROUP), "_d": average_rank(F.col("decile"), GROUP)})
    n = F.count("*")
    enough = n >= 2
    return df.groupBy(*GROUP).agg(
        n.alias("valid_decile_count"), F.when(enough, safe_corr(F.col("_d"), F.col("_r"))).alias("decile_return_spearman"),
        F.when(enough, F.bool_and(F.col("_step") > 0)).otherwise(False).alias("strict_monotonic_increasing"),
        F.when(enough, F.bool_and(F.col("_step") >= 0)).otherwise(False).alias("nonstrict_monotonic_increasing"),
        F.when(enough, F.sum((F.col("_step") < 0).cast("int"))).alias("adjacent_violation_count"),
    )
