"""Exact ranks, running totals and quantiles of groups of any size.

No task sorts a whole group. Rows are split by bounds that are sampled from the data, into ranges of about equal numbers of
rows, and stay in order from range to range. Totals of the ranges, a few rows, give what precedes each range; within
a range a window adds what precedes each row. Equal values become one row with a count first, so a value that most rows
hold is no hot range.

Quantiles are narrowed first: a sketch names two values that enclose each quantile, rows below them are only counted, and
the ranges hold just the rows between. Whether the values enclose it is checked by the counts; a group whose sketch
missed goes through whole.

Steps that are read more than once are written by ``store`` (a function from a DataFrame to the DataFrame that reads
it), so calling these functions runs jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.sinks.stored import stored

#: Rank error of the sketch that encloses quantiles: one in so many.
ACCURACY = 2000
#: A table of groups up to this many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES, GROUP_BYTES = 16 << 20, 512

Store = Callable[[DataFrame], DataFrame]


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _with_groups(df: DataFrame, groups: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` with the columns of its group's row."""
    small = F.broadcast(groups) if rows * GROUP_BYTES <= BROADCAST_BYTES else groups
    return df.alias("l").join(small.alias("r"), _same("l", "r", keys)).select("l.*", *[f"r.{c}" for c in groups.columns if c not in keys])


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str], store: Store = stored) -> DataFrame:
    """``df`` with before_x for each column x of ``sums``: its total over the rows of the same group that precede by ``order``.

    ``order`` should tell rows of a group apart: rows that it doesn't tell apart may follow each other in any order, and lie in one range.
    """
    spread = store(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = store(spread.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums]))  # ranges and groups at most
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *keys, *[F.sum(f"_t_{c}").over(earlier).alias(f"_o_{c}") for c in sums])
    both = _with_groups(spread, offsets, ["_range", *keys], totals.count())
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    both = both.withColumns({f"before_{c}": F.coalesce(F.col(f"_o_{c}"), zero) + F.coalesce(F.sum(c).over(within), zero) for c in sums})
    return both.drop("_range", *[f"_o_{c}" for c in sums])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", store: Store = stored) -> DataFrame:
    """``df`` with the place of each row in its group, 1, 2, 3, ... by ``order`` (ascending, nulls first)."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"], store)
    return out.withColumn(name, F.col("before__one") + 1).drop("_one", "before__one")


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], store: Store = stored, accuracy: int = ACCURACY) -> DataFrame:
    """``keys``, n (values that aren't null) and a column for each name of ``at``: the exact quantile, between two values by linear interpolation.

    Groups without values have no row. NaN is the largest value.
    """
    some = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    margin = 2 / accuracy
    low, high = [max(0.0, q - margin) for q in at.values()], [min(1.0, q + margin) for q in at.values()]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(x) for x in [*low, *high]]), F.lit(accuracy))
    groups = store(some.groupBy(*keys).agg(F.count("*").alias("n"), sketch.alias("_b")))
    out = store(_enclosed(some, groups, keys, list(at.values()), store).where(F.forall("_q", lambda x: x.isNotNull())))
    missed = groups.alias("l").join(out.alias("r"), _same("l", "r", keys), "left_anti")
    if missed.head(1):
        whole = F.array(*[F.lit(x) for x in [-math.inf] * len(at) + [math.nan] * len(at)])
        out = out.union(store(_enclosed(some, store(missed.withColumn("_b", whole)), keys, list(at.values()), store)))
    return out.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(at)])


def _enclosed(some: DataFrame, groups: DataFrame, keys: list[str], at: list[float], store: Store) -> DataFrame:
    """Of each group with a value within its bounds _b: keys, n, and _q with the quantiles ``at``; null where the bounds don't enclose one."""
    k, v, b = len(at), F.col("_v"), F.col("_b")
    rows = groups.count()
    held = _with_groups(some, groups, keys, rows)
    below = held.groupBy(*keys).agg(F.array(*[F.count_if(v < b[i]) for i in range(k)]).alias("_below"))
    inside = F.array_compact(F.array(*[F.when((v >= b[i]) & (v <= b[k + i]), F.lit(i)) for i in range(k)]))
    tally = held.select(*keys, "_v", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_m"))
    return _found(tally, below, groups, keys, at, rows, store)


def _found(tally: DataFrame, below: DataFrame, groups: DataFrame, keys: list[str], at: list[float], rows: int, store: Store) -> DataFrame:
    """``_enclosed`` from the values inside the bounds with their counts, and the numbers of values below."""
    k, v = len(at), F.col("_v")
    placed = running(tally, [*keys, "_i"], ["_v"], ["_m"], store)
    placed = _with_groups(placed, store(below.alias("l").join(groups.drop("_b").alias("r"), _same("l", "r", keys)).select("l.*", "r.n")), keys, rows)
    before = F.col("before__m") + F.col("_below")[F.col("_i")]
    place = F.array(*[F.lit(float(q)) for q in at])[F.col("_i")] * (F.col("n") - 1)
    covers = lambda x: F.when((before <= x) & (x < before + F.col("_m")), v)
    ends = placed.withColumn("_p", place).groupBy(*keys, "_i", "_p", "n").agg(F.max(covers(F.floor("_p"))).alias("_a"), F.max(covers(F.ceil("_p"))).alias("_z"))
    p = F.col("_p")
    exact = F.when(F.floor(p) == F.ceil(p), F.col("_a")).otherwise((F.ceil(p) - p) * F.col("_a") + (p - F.floor(p)) * F.col("_z"))
    found = ends.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_i", exact))).alias("_m"))  # ``at`` entries
    return found.select(*keys, "n", F.array(*[F.element_at("_m", F.lit(i)) for i in range(k)]).alias("_q"))


def described(df: DataFrame, values: list[Column], q: float, store: Store = stored, accuracy: int = ACCURACY) -> DataFrame:
    """A row for each of ``values``, by its place f: n (values that aren't null), mean, deviation (population) and the exact quantile (null without values).

    Rows stay as they are: one pass sketches and sums all columns at once, one counts what lies below the bounds, and one sends just the
    values within them. ``quantiles`` over a row for each value would send and group as many rows as there are values.
    """
    vs = [v.cast("double") for v in values]
    margin = 2 / accuracy
    ends = F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin)))
    of = [F.struct(F.lit(i).alias("f"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.percentile_approx(v, ends, F.lit(accuracy)).alias("_b")) for i, v in enumerate(vs)]
    about = store(df.agg(F.array(*of).alias("_a")).select(F.inline("_a")))
    groups = about.where("n > 0").select("f", "n", "_b")
    bounds = [(r.f, vs[r.f], *r._b) for r in groups.collect()]  # a row for each column
    if not bounds:
        return about.drop("_b").withColumn("quantile", F.lit(None).cast("double"))
    below = df.agg(F.array(*[F.struct(F.lit(i).alias("f"), F.array(F.count_if(v < a)).alias("_below")) for i, v, a, _ in bounds]).alias("_a")).select(F.inline("_a"))
    within = [(i, v, (v >= a) & (v <= z)) for i, v, a, z in bounds]
    some = F.lit(False)
    for _, _, inside in within:
        some = some | F.coalesce(inside, F.lit(False))
    cells = df.where(some).select(F.explode(F.array_compact(F.array(*[F.when(inside, F.struct(F.lit(i).alias("f"), v.alias("_v"))) for i, v, inside in within]))).alias("c"))
    tally = cells.groupBy("c.f", F.lit(0).alias("_i"), "c._v").agg(F.count("*").alias("_m"))
    out = store(_found(tally, store(below), groups, ["f"], [q], len(bounds), store).select("f", F.col("_q")[0].alias("quantile")).where("quantile is not null"))
    hit = {r.f for r in out.collect()}
    if missed := [(i, v) for i, v, *_ in bounds if i not in hit]:  # the sketch missed these, so they go whole
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), v.alias("v")) for i, v in missed])).alias("c")).select("c.f", "c.v")
        out = out.union(quantiles(long, ["f"], "v", {"quantile": q}, store).select("f", "quantile"))
    return about.drop("_b").join(F.broadcast(out), "f", "left")
