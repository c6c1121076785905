"""Quality checks of the stored tables."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.order import ranked

# workers may not find this package, so functions go to them with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def by_year(df: DataFrame) -> DataFrame:
    """Rows, codes, first and last date and the number of duplicate keys of each year."""
    keys = df.groupBy("date", "code").agg(F.count("*").alias("k"))
    return keys.groupBy(F.year("date").alias("year")).agg(F.sum("k").alias("n_rows"), F.countDistinct("code").alias("n_codes"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum((F.col("k") > 1).cast("int")).alias("n_duplicate_keys"))


def missing_years(years: DataFrame, first: int, last: int) -> DataFrame:
    wanted = years.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(years, "year", "left_anti")


def images(df: DataFrame, height: int, width: int, horizons: tuple[int, ...]) -> DataFrame:
    """One row of counts over image rows (date, code, image, label_hd, future_ret_hd): wrong sizes, other than two pixel values, duplicate keys, unpaired labels."""
    text = F.decode("image", "ISO-8859-1")  # a byte is a character
    other = F.length(F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\xff"), F.lit(""))) > 0
    unpaired: Column = F.lit(0)
    for h in horizons:
        unpaired = unpaired + (F.col(f"label_{h}d").isNull() != F.col(f"future_ret_{h}d").isNull()).cast("int")
    checked = df.withColumns({"_bad": (F.length("image") != height * width).cast("int"), "_other": other.cast("int"), "_unpaired": unpaired})
    keys = checked.groupBy("date", "code").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("_bad", "_other", "_unpaired")])
    return keys.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_images"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("_bad", "n_wrong_size"), ("_other", "n_not_binary"), ("_unpaired", "n_unpaired_labels"))], F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("n_duplicate_keys"), F.min("date").alias("first"), F.max("date").alias("last"))


def label_stats(df: DataFrame, horizons: tuple[int, ...], end: dt.date) -> DataFrame:
    """For each horizon: rows whose label and return are known, rows without, and known ones so late that they can't be complete (a guide, as days aren't trading days)."""
    stats = []
    for h in horizons:
        valid = F.col(f"label_{h}d").isNotNull() & F.col(f"future_ret_{h}d").isNotNull()
        late = valid & (F.col("date") > F.lit(end - dt.timedelta(days=h + 5)))
        stats.append(F.struct(F.lit(h).alias("horizon"), F.count_if(valid).alias("valid_rows"), F.count_if(~valid).alias("missing_rows"), F.count_if(late).alias("late_valid_rows")))
    return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))


#: Pairs of images of a task.
TASK_IMAGES = 1 << 17


def _differences(batches: Iterator) -> Iterator:
    """Sums over pairs of images, which are null where they are alike; a byte that one of them lacks counts as -1."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        pixels, most = 0, 0
        for x, y in zip(*(batch.column(c).drop_null() for c in "xy")):
            a, b = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int16) for v in (x, y))
            if len(a) != len(b):
                a, b = (np.pad(v, (0, max(len(a), len(b)) - len(v)), constant_values=-1) for v in (a, b))
            d = np.abs(a - b)
            pixels, most = pixels + int(np.count_nonzero(d)), max(most, int(d.max()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((batch.num_rows, pa.int64()), (pixels, pa.int64()), (most, pa.int32()), (sum(batch.column("wrong").to_pylist()), pa.int64()))], names=["n", "pixels", "most", "wrong"])


def compare_images(new: DataFrame, old: DataFrame, sample: int, horizons: tuple[int, ...], seed: int = 20260828) -> DataFrame:
    """One row: common keys, and over ``sample`` of them pixels that differ, the largest difference, and labels or returns that differ by more than 1e-6.

    The sample are the keys with the least seeded hashes, which each task finds among its own keys first.
    """
    values = [f"{p}_{h}d" for h in horizons for p in ("label", "future_ret")]
    one, two = (df.select("date", "code", F.struct("image", *values).alias(name)) for df, name in ((new, "a"), (old, "b")))
    both = one.join(two, ["date", "code"])
    common = both.count()  # keys, and the sample's choice, are small beside the images
    n = -(-common // TASK_IMAGES)
    if n > int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = one.repartition(n, "date", "code").join(two.repartition(n, "date", "code"), ["date", "code"])
    some = both
    if common > sample:
        keys = both.select("date", "code", F.xxhash64(F.lit(seed), "date", "code").alias("_h"))
        some = both.join(ranked(keys, [], ["_h", "date", "code"], "_k").where(F.col("_k") <= sample).select("date", "code").distinct(), ["date", "code"])
    wrong = F.lit(0)
    for c in values:
        p, q = F.col(f"a.{c}").cast("double"), F.col(f"b.{c}").cast("double")
        same = (p.isNull() & q.isNull()) | F.coalesce(F.abs(p - q) <= 1e-6 + 1e-6 * F.abs(q), F.lit(False))
        wrong = wrong + (~same).cast("int")
    x, y = F.col("a.image"), F.col("b.image")
    unlike = some.select(F.when(x != y, x).alias("x"), F.when(x != y, y).alias("y"), wrong.alias("wrong"))
    found = unlike.mapInArrow(_differences, "n long, pixels long, most int, wrong long").agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in (("n_sampled", F.sum("n")), ("n_pixel_mismatch", F.sum("pixels")), ("max_pixel_difference", F.max("most")), ("n_value_mismatch", F.sum("wrong")))])
    return found.select(F.lit(common).cast("long").alias("n_common"), *found.columns)


def predictions(df: DataFrame, members: int | None = None) -> DataFrame:
    """Rows, dates, duplicate keys, scores that are missing or not finite, and the member counts that occur, for each experiment and model."""
    keys = ["experiment_name", "model_name"]
    count = F.col("ensemble_member_count") if "ensemble_member_count" in df.columns else F.lit(members)
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    one = df.groupBy(*keys, "date", "code").agg(F.count("*").alias("k"), F.sum(bad.cast("int")).alias("bad"), F.min(count).alias("lo"), F.max(count).alias("hi"))
    return one.groupBy(*keys).agg(F.sum("k").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.sum((F.col("k") > 1).cast("int")).alias("n_duplicate_keys"), F.sum("bad").alias("n_missing_scores"), F.min("lo").alias("min_members"), F.max("hi").alias("max_members"))


def year_faults(df: DataFrame, years: range, required: tuple[str, ...], name: str) -> tuple[list, list[str]]:
    """Rows of ``by_year`` (one for each year), and what is wrong with a table by year."""
    faults = [f"{name}: missing column {c}" for c in required if c not in df.columns]
    if not {"date", "code"} <= set(df.columns):
        return [], faults
    if n := df.where("date is null or code is null").count():
        faults.append(f"{name}: {n} rows without a key")
    rows = sorted(by_year(df.where("date is not null and code is not null")).collect(), key=lambda r: r.year)
    there = {r.year for r in rows}
    faults += [f"{name}: no row of {y}" for y in years if y not in there] + [f"{name}: rows of {y}, which isn't expected" for y in sorted(there - set(years))]
    faults += [f"{name}: {r.n_duplicate_keys} keys of {r.year} more than once" for r in rows if r.n_duplicate_keys]
    return rows, faults


def image_faults(row, rows_of_dates: tuple[dt.date, dt.date], name: str) -> list[str]:
    """What is wrong by a row of ``images``."""
    said = {"n_wrong_size": "images of another size", "n_not_binary": "images of other than two values", "n_duplicate_keys": "keys more than once", "n_unpaired_labels": "labels without return, or returns without label"}
    out = [f"{name}: {row[c]} {what}" for c, what in said.items() if row[c]]
    if not row.n_images:
        return [f"{name}: no images"]
    if row["first"] < rows_of_dates[0] or row["last"] > rows_of_dates[1]:
        out.append(f"{name}: dates from {row['first']} to {row['last']}, outside {rows_of_dates[0]} to {rows_of_dates[1]}")
    return out
