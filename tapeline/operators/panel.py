"""Panel: raw and adjusted prices of a code and day in one row, with its basic flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.functions.exprs import to_day, to_flag, to_number, zfill_code
from tapeline import schema
from tapeline.schema import ADJUSTED, conform

KEYS = ["date", "code"]


def clean(df: DataFrame, names: dict[str, str], numbers: list[str], flags: list[str] = (), days: list[str] = ()) -> DataFrame:
    """Mapped columns under their new names: code as six digits, dates, numbers and flags read from text; rows without a key go."""
    found = {new: F.col(f"`{old}`") for old, new in names.items() if old in df.columns}
    out = []
    for new, c in found.items():
        kind = zfill_code(c) if new == "code" else to_day(c) if new in ("date", *days) else to_number(c) if new in numbers else to_flag(c) if new in flags else c
        out.append(kind.alias(new))
    return df.select(*out).where(F.col("date").isNotNull() & F.col("code").isNotNull())


def in_range(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    return df.where(F.col("date").between(F.lit(cfg.start), F.lit(cfg.end)))


def duplicate_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys of more than one row, with the count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def merge_prices(raw: DataFrame | None, adjusted: DataFrame | None, check: bool = False) -> DataFrame:
    """Full outer join of both tables by key; missing adjusted prices fall back on raw ones, which sets ``used_raw_as_adj``.

    Either table may be absent. With ``check``, keys that aren't unique on a side are an error.
    """
    for side in (raw, adjusted) if check else ():
        if side is not None and (bad := duplicate_keys(side).head(1)):
            raise ValueError(f"not one row for each key: {bad[0]}")
    if raw is None and adjusted is None:
        raise ValueError("neither raw nor adjusted prices")
    return fallen_back(adjusted if raw is None else raw if adjusted is None else raw.join(adjusted, KEYS, "full"))


def fallen_back(df: DataFrame) -> DataFrame:
    """Rows of both tables' columns (an absent table has none): missing adjusted prices fall back on raw ones."""
    have = set(df.columns)
    adj = {c: F.col(c) if c in have else F.lit(None).cast("double") for c in ADJUSTED}
    missing = F.lit(False)
    for c in adj.values():
        missing = missing | c.isNull()
    filled = {c: F.coalesce(v, F.col(c.replace("_adj", "_raw")).cast("double") if c.replace("_adj", "_raw") in have else F.lit(None).cast("double")) for c, v in adj.items()}
    return df.withColumns({"used_raw_as_adj": missing.cast("int"), **filled})


def basic_flags(df: DataFrame) -> DataFrame:
    """is_suspended, days_since_list, is_tradable_basic; a null amount or volume counts as none, an absent column doesn't."""
    stopped = F.lit(False)
    for c in ("amount", "volume"):
        if c in df.columns:
            stopped = stopped | (F.coalesce(F.col(c), F.lit(0.0)) <= 0)
    for c in ADJUSTED:
        stopped = stopped | F.col(c).isNull()
    st = F.coalesce(F.col("is_st"), F.lit(0)) if "is_st" in df.columns else F.lit(0)
    days = F.datediff("date", "list_date").cast("double") if "list_date" in df.columns else F.lit(None).cast("double")
    return df.withColumns({"is_suspended": stopped.cast("int"), "is_st": st.cast("int"), "days_since_list": days}).withColumn("is_tradable_basic", ((F.col("is_st") == 0) & (F.col("is_suspended") == 0)).cast("int"))


def build_panel(raw: DataFrame | None, adjusted: DataFrame | None, cfg: EngineConfig | None = None, check: bool = False) -> DataFrame:
    """The merged panel with its flags, within the configuration's dates; ``check`` as in ``merge_prices``."""
    df = basic_flags(merge_prices(raw, adjusted, check))
    return in_range(df, cfg) if cfg else df


def panel_of_pairs(pairs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``build_panel`` of two tables whose rows of one key lie in one row already, as their outer join has them."""
    return in_range(basic_flags(fallen_back(pairs)), cfg)


def to_storage(df: DataFrame) -> DataFrame:
    """The stored form of a panel: its schema, null flags 0."""
    return conform(df.where("date is not null and code is not null"), schema.panel())


def build_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("code").alias("n_codes"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
