"""Costs, long-short spread, NAV, performance, attribution and cost sensitivity of portfolio days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.functions.exprs import safe_div
from tapeline.operators.cross_section import GROUP

SERIES = [*GROUP, "decile", "portfolio_name", "cost_bps"]
COMPONENTS = ("signal_gross_alpha", "buy_blocked_loss", "sell_blocked_forced_hold_loss", "missing_return_data_issue", "turnover_cost", "net_return", "attributed_net_return")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def with_costs(days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each row for each cost: net return, cost, the plug term and the attributed return."""
    df = days.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in cfg.costs_bps])))
    df = df.withColumn("turnover_cost", F.col("turnover") * (F.col("cost_bps") / 10_000.0)).withColumn("net_return", F.col("gross_return") - F.col("turnover_cost"))
    known = _zero("signal_gross_alpha") - _zero("buy_blocked_loss") - _zero("sell_blocked_forced_hold_loss")
    df = df.withColumn("missing_return_data_issue", known - _zero("turnover_cost") - _zero("net_return"))
    return df.withColumn("attributed_net_return", known - F.col("missing_return_data_issue") - _zero("turnover_cost"))


def long_short(days: DataFrame, top: int = 10, bottom: int = 1) -> DataFrame:
    """top - bottom on days that have both: differences of returns, sums of turnover and costs, the smaller valid weight."""
    keys = ["date", *GROUP, "cost_bps"]
    pick = lambda c, d: F.max(F.when(F.col("decile") == d, F.col(c)))
    less = [(pick(c, top) - pick(c, bottom)).alias(c) for c in ("gross_return", "signal_gross_alpha", "buy_constrained_gross_return", "buy_blocked_loss", "sell_blocked_forced_hold_loss")]
    more = [(pick(c, top) + pick(c, bottom)).alias(c) for c in ("turnover", "start_turnover", "end_turnover", "turnover_cost", "num_holdings")]
    df = days.where(F.col("decile").isin(top, bottom)).groupBy(*keys).agg(*less, *more, F.least(pick("valid_weight", top), pick("valid_weight", bottom)).alias("valid_weight"), F.bool_or("is_warmup").alias("is_warmup"), F.countDistinct("decile").alias("_n"))
    df = df.where("_n = 2").drop("_n").withColumns({"decile": F.lit(0), "portfolio_name": F.lit("D10_minus_D1"), "net_return": F.col("gross_return") - F.col("turnover_cost")})
    known = _zero("signal_gross_alpha") - _zero("buy_blocked_loss") - _zero("sell_blocked_forced_hold_loss")
    df = df.withColumn("missing_return_data_issue", known - _zero("turnover_cost") - _zero("net_return"))
    return df.withColumn("attributed_net_return", known - F.col("missing_return_data_issue") - _zero("turnover_cost"))


def nav(days: DataFrame) -> DataFrame:
    """Compounded gross and net values after the warm-up, and the net drawdown; days without either return go."""
    df = days.where("not is_warmup and gross_return is not null and net_return is not null")
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"gross_nav": F.product(1 + F.col("gross_return")).over(w), "net_nav": F.product(1 + F.col("net_return")).over(w)})
    return df.withColumn("drawdown", safe_div(F.col("net_nav"), F.max("net_nav").over(w)) - 1).select("date", *SERIES, "gross_nav", "net_nav", "drawdown")


def performance(days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Annualised figures, drawdown, win rate, turnover and coverage of each series; one without a net return after the warm-up has none."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    on = ~F.col("is_warmup")
    df = days.withColumns({"_g": F.when(on, F.col("gross_return")), "_n": F.when(on, F.col("net_return"))})
    df = df.withColumns({"_gn": F.product(1 + F.coalesce("_g", F.lit(0.0))).over(w), "_nn": F.product(1 + F.coalesce("_n", F.lit(0.0))).over(w)})
    df = df.withColumn("_dd", F.when(F.col("_n").isNotNull(), safe_div(F.col("_nn"), F.max(F.when(F.col("_n").isNotNull(), F.col("_nn"))).over(w)) - 1))
    year = cfg.days_per_year
    mean, sd = F.avg("_n") * year, F.stddev_samp("_n") * F.sqrt(F.lit(float(year)))
    last = lambda value, given: F.max_by(value, F.when(F.col(given).isNotNull(), F.col("date")))
    out = df.groupBy(*SERIES).agg(
        F.count("_n").alias("n_periods"), F.count("*").alias("n_total_days"), F.sum(F.col("is_warmup").cast("int")).alias("n_warmup_days"), mean.alias("annualized_return"), sd.alias("annualized_volatility"), safe_div(mean, F.when(sd > 0, sd)).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"), F.avg((F.col("_n") > 0).cast("double")).alias("win_rate"), F.avg(F.when(on, F.col("turnover"))).alias("avg_turnover"), F.avg(F.when(on, F.col("net_return").isNotNull().cast("double"))).alias("valid_day_ratio"),
        F.avg(F.when(on, F.col("valid_weight"))).alias("avg_valid_weight"), F.avg(F.when(on, (F.round("valid_weight", 12) < cfg.low_coverage).cast("double"))).alias("low_coverage_day_ratio"), last("_gn", "_g").alias("final_gross_nav"), last("_nn", "_n").alias("final_net_nav"),
    ).where("n_periods > 0")
    return out.withColumns({"gross_cumulative_return": F.col("final_gross_nav") - 1, "net_cumulative_return": F.col("final_net_nav") - 1})


def attribution(days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Mean, annualised and summed components after the warm-up, and what they leave of the annualised net return."""
    aggs = [F.count("net_return").alias("n_periods")]
    for c in COMPONENTS:
        aggs += [F.avg(c).alias(f"mean_daily_{c}"), (F.avg(c) * cfg.days_per_year).alias(f"annualized_{c}"), F.sum(c).alias(f"cumulative_linear_{c}")]
    df = days.where("not is_warmup").groupBy(*SERIES).agg(*aggs)
    return df.withColumn("annualized_attribution_residual", F.col("annualized_net_return") - F.col("annualized_attributed_net_return"))


def cost_sensitivity(performed: DataFrame) -> DataFrame:
    return performed.select(*SERIES, "n_periods", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "win_rate", "avg_turnover", "avg_valid_weight", "net_cumulative_return", "final_net_nav")


def long_only(df: DataFrame, decile: int = 10) -> DataFrame:
    """The extract of one decile."""
    return df.where(F.col("decile") == decile)
