"""Column expressions: cleaning, safe arithmetic, ranks and correlations, under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Texts that stand for a missing number; texts of a set and an unset flag.
MISSING = ("--", "-", "", "nan", "None")
YES, NO = ("是", "Y", "True"), ("否", "N", "False")


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def zfill_code(c: Column, width: int = 6) -> Column:
    """The first run of digits, padded with zeros to ``width`` but never cut; null without digits."""
    digits = F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit(""))
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def to_number(c: Column) -> Column:
    """Text as a double: placeholders and what can't be read are null, commas go, so do infinities and NaN."""
    t = F.trim(c.cast("string"))
    x = F.when(~t.isin(*MISSING), F.replace(t, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_flag(c: Column) -> Column:
    """1 or 0 from yes/no texts or numbers; everything else is 0."""
    t = F.trim(c.cast("string"))
    number = F.coalesce(t.try_cast("double"), F.lit(0.0))
    return F.when(t.isin(*YES), 1).when(t.isin(*NO), 0).otherwise(number.cast("int")).cast("int")


def to_day(c: Column) -> Column:
    """A calendar day from a text or a time; null if it can't be read."""
    t = c.cast("string")
    return F.coalesce(F.substring(t, 1, 10).try_cast("date"), F.try_to_date(t, "yyyyMMdd"), F.try_to_date(t, "yyyy/M/d"))


def limit_threshold(code: Column, date: Column, is_st: Column, cfg) -> Column:
    """Per cent of a price limit: wide boards by prefix (some from a date on), special treatment last."""
    always = F.lit(False)
    for p in cfg.wide_always:
        always = always | code.startswith(p)
    since = F.lit(False)
    for p in cfg.wide_since:
        since = since | code.startswith(p)
    return F.when(is_st == 1, cfg.limit_st).when(always | (since & (date >= F.lit(cfg.wide_date))), cfg.limit_wide).otherwise(cfg.limit_default)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null under two rows or two distinct values on either side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(value: Column, keys: Sequence[str | Column]) -> Column:
    """Rank within ``keys`` from 1, ties averaged: both from one sort."""
    w = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def first_rank(order: Sequence[Column], keys: Sequence[str | Column]) -> Column:
    """Rank within ``keys`` from 1, ties by the order's later columns."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def quantile_group(rank: Column, n: Column, groups: int = 10) -> Column:
    """Group 1..groups of a rank 1..n by linear quantile edges; null with fewer than ``groups`` rows."""
    out = F.lit(1)
    for k in range(1, groups):
        out = out + (rank > 1 + F.lit(k / groups) * (n - 1)).cast("int")
    return F.when(n >= groups, out)


def diagnostic_group(rank: Column, n: Column, groups: int = 10) -> Column:
    """The other rule: the rank's share times ``groups``, rounded up, within 1..groups."""
    return F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil(rank * groups / n))).cast("int")


def over_full(agg: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A window aggregate, null unless all n rows hold a value."""
    return F.when(F.count(counted).over(w) == n, agg.over(w))


def pixel_row(price: Column, low: Column, high: Column, rows: int) -> Column:
    """Row from the top of the price area; half-even rounding, clipped."""
    y = F.rint(safe_div(high - price, high - low) * (rows - 1))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(rows - 1)), y)).cast("int")


def clipped_sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def model_family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("logistic")), "Logistic").when(F.contains(low, F.lit("cnn")), "CNN")


def code_bucket(code: Column, buckets: int = 128) -> Column:
    """Number of digits' value modulo ``buckets``; 0 without digits."""
    digits = F.regexp_extract(code, r"(\d+)", 1)
    return F.coalesce(F.pmod(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(buckets)), F.lit(0)).cast("int")


def join_codes(codes: Column) -> Column:
    """A set of codes as text, sorted, with bars between."""
    return F.array_join(F.array_sort(F.array_distinct(codes)), "|")


def split_codes(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: x != "")
