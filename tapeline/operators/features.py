"""Features and labels: everything that is per code in order of date, over rows, not days.

All columns share one window partition, so the plan has one exchange and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline import schema
from tapeline.config import EngineConfig
from tapeline.functions.exprs import limit_threshold, over_full, safe_div
from tapeline.schema import conform


def by_code():
    """Rows of a code in order of date."""
    return Window.partitionBy("code").orderBy("date")


def last_rows(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def returns(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """ret_nd; a missing close is filled with the last one first if the configuration pads."""
    df = df.withColumn("_c", F.last("close_adj", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0)) if cfg.pad_missing_returns else F.col("close_adj"))
    return df.withColumns({f"ret_{n}d": safe_div(F.col("_c"), F.lag("_c", n).over(by_code())) - 1 for n in cfg.return_windows}).drop("_c")


def labels(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """open_to_close_ret_1d; future_ret_hd from the next open to the h-th close, and its sign as a label."""
    out = {"open_to_close_ret_1d": safe_div(F.col("close_adj"), _positive(F.col("open_adj"))) - 1}
    for h in cfg.horizons:
        out[f"future_ret_{h}d"] = safe_div(_positive(F.lead("close_adj", h).over(by_code())), _positive(F.lead("open_adj", 1).over(by_code()))) - 1
    df = df.withColumns(out)
    return df.withColumns({f"label_{h}d": F.when(F.col(f"future_ret_{h}d").isNotNull(), (F.col(f"future_ret_{h}d") > 0).cast("double")) for h in cfg.horizons})


def constraints(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Volume against the mean of the 20 rows before, and limit moves on little volume."""
    before = by_code().rowsBetween(-20, -1)
    df = df.withColumns({"limit_pct": limit_threshold(F.col("code"), F.col("date"), F.col("is_st"), cfg), "volume_mean_20d_prev": over_full(F.avg("volume"), F.col("volume"), before, 20)})
    mean = F.col("volume_mean_20d_prev")
    low = (mean > 0) & (F.col("volume") <= cfg.low_volume_ratio * mean)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns({
        "volume_ratio_to_20d_prev": safe_div(F.col("volume"), mean),
        "is_low_volume_limit_up": flag(low & (F.col("pct_chg") >= F.col("limit_pct"))),
        "is_low_volume_limit_down": flag(low & (F.col("pct_chg") <= -F.col("limit_pct"))),
    })


def baselines(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Moving averages and gaps, positions in the range, volatility, amount changes, reversal and momentum, log market value."""
    out: dict[str, Column] = {}
    close = F.col("close_adj")
    for n in cfg.ma_windows:
        out[f"ma{n}_adj"] = over_full(F.avg("close_adj"), close, last_rows(n), n)
    for n in cfg.position_windows:
        low = over_full(F.min("low_adj"), F.col("low_adj"), last_rows(n), n)
        high = over_full(F.max("high_adj"), F.col("high_adj"), last_rows(n), n)
        out[f"position_{n}d"] = safe_div(close - low, high - low)
    for n in cfg.vol_windows:
        out[f"vol_{n}d"] = over_full(F.stddev_samp("ret_1d"), F.col("ret_1d"), last_rows(n), n)
    rolled = {"amount": "amount", "turnover": "turnover_rate"}
    for name, c in rolled.items():
        if c in df.columns:
            out[f"{name}_mean_20d"] = over_full(F.avg(c), F.col(c), last_rows(20), 20)
    out |= {"reversal_5d": -F.col("ret_5d"), "reversal_10d": -F.col("ret_10d"), "momentum_20d": F.col("ret_20d"), "momentum_60d": F.col("ret_60d")}
    out |= {f"log_{c}": F.when(F.col(c) > 0, F.ln(c)) for c in ("float_mktcap", "total_mktcap") if c in df.columns}
    df = df.withColumns(out)
    more = {f"ma{n}_gap": safe_div(close, F.col(f"ma{n}_adj")) - 1 for n in cfg.ma_windows}
    more |= {f"{name}_change_20d": safe_div(F.col(c), F.col(f"{name}_mean_20d")) - 1 for name, c in rolled.items() if c in df.columns}
    return df.withColumns(more)


def tradable(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The final flag: basic, enough amount (null fails), listed long enough (unknown passes)."""
    ok = (F.col("is_tradable_basic") == 1) & (F.col("is_st") == 0) & (F.col("is_suspended") == 0) & (F.col("amount") >= cfg.min_amount) & (F.col("days_since_list").isNull() | (F.col("days_since_list") >= cfg.min_list_days))
    return df.withColumn("is_tradable", F.coalesce(ok, F.lit(False)).cast("int"))


def build_features(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    if "pct_chg" not in panel.columns:
        panel = panel.withColumn("pct_chg", (safe_div(F.col("close_adj"), F.lag("close_adj", 1).over(by_code())) - 1) * 100)
    return tradable(baselines(constraints(labels(returns(panel, cfg), cfg), cfg), cfg), cfg)


def to_storage(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The stored form of the features: their schema, null flags 0."""
    return conform(df, schema.features(cfg))


def sample_mask(df: DataFrame, horizon: int, needed: list[str]) -> DataFrame:
    """Rows that a model may learn from: tradable, label and return known, needed columns present."""
    ok = (F.col("is_tradable") == 1) & F.col(f"label_{horizon}d").isNotNull() & F.col(f"future_ret_{horizon}d").isNotNull()
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def experiment_view(df: DataFrame, horizon: int) -> DataFrame:
    """label and future_ret of one horizon under common names, both known."""
    return df.withColumns({"label": F.col(f"label_{horizon}d"), "future_ret": F.col(f"future_ret_{horizon}d")}).where("label is not null and future_ret is not null")
