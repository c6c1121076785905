"""Portfolio books as sets: overlapping cohorts, and non-overlapping cycles with a short leg.

A position is (group, decile, signal position, code). Its first and target days follow from the
signal; whether it can be bought, from that code's row on the first day; when it leaves, from the first
day at or after the target on which the code can be sold. So positions are exploded over their days
and aggregated; nothing is simulated day by day. Positions count trading days of the whole calendar.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.functions.exprs import safe_div
from tapeline.operators import books
from tapeline.operators.books import BOOKS
from tapeline.operators.cross_section import GROUP
from tapeline.operators.order import BROADCAST_BYTES, GROUP_BYTES
from tapeline.operators.targets import calendar
from tapeline.sinks.stored import stored

BOOK = [*GROUP, "decile"]
CODED = ["g", "decile"]


#: Numbers of an execution row, and those of them that opening asks for.
NUMBERS = ("ret_1d", "open_to_close_ret_1d", "volume")
OPENING = NUMBERS[1:]


def daily_context(features: DataFrame, day: str = "date", numbers: tuple[str, ...] = NUMBERS) -> DataFrame:
    """Execution rows, one for each date and code: numbers averaged and flags maximised over duplicates; null flags are 0."""
    flags = ("is_suspended", "is_low_volume_limit_up", "is_low_volume_limit_down")
    df = features.where(F.col(day).isNotNull() & F.col("code").isNotNull())
    return df.groupBy(day, "code").agg(*[F.avg(c).alias(c) for c in numbers], *[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in flags])


class Placed(NamedTuple):
    """The calendar (date, pos), and the daily rows by position with short names."""

    calendar: DataFrame
    days: DataFrame


def placed(daily: DataFrame | Placed) -> Placed:
    """Daily rows (of ``daily_context``) in their places; what is placed already stays, so several books share it."""
    if isinstance(daily, Placed):
        return daily
    daily = stored(daily_context(daily))
    cal = stored(calendar(daily))
    return Placed(cal, stored(_short(daily.join(F.broadcast(cal), "date"))))


_SHORT = {"ret_1d": "ret", "open_to_close_ret_1d": "o2c", "volume": "vol", "is_suspended": "susp", "is_low_volume_limit_up": "up", "is_low_volume_limit_down": "down"}


def _short(daily: DataFrame) -> DataFrame:
    return daily.select("pos", "code", *[F.col(c).alias(new) for c, new in _SHORT.items() if c in daily.columns])


def trading_days(features: DataFrame | Placed) -> DataFrame:
    """The calendar of daily rows; of features, a stored table of its own."""
    return features.calendar if isinstance(features, Placed) else stored(calendar(features.where("code is not null")))


def opening_days(features: DataFrame | Placed, cal: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """Execution rows of the days ``starts`` (pos) alone, by code and day over ``n`` partitions; of all other days nothing is sent."""
    if isinstance(features, Placed):
        return features.days.join(F.broadcast(starts), "pos", "left_semi").repartition(n, "code", "pos")
    days = features.join(F.broadcast(cal.join(F.broadcast(starts), "pos", "left_semi")), "date").repartition(n, "code", "pos")
    return _short(daily_context(days, "pos", OPENING))


def signals(pred: DataFrame, cal: DataFrame, overlapping: bool) -> DataFrame:
    """Positions with their first day and target day, as often as ``pred`` has them.

    Overlapping: the target is cut at the last day. Otherwise only every H-th calendar position from a group's first signal on trades, and a cycle whose target lies beyond the last day is dropped.
    """
    df = pred.where("decile is not null").select(*GROUP, "horizon", "decile", "date", "code")
    df = df.join(F.broadcast(cal), "date").withColumnRenamed("pos", "signal_pos").drop("date")
    if not overlapping:
        df = stored(df)
        first = df.groupBy(*GROUP, "horizon").agg(F.min("signal_pos").alias("_a"))  # a row for each group and horizon, a few dozen
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*GROUP, "horizon")]
        df = df.alias("l").join(F.broadcast(first).alias("r"), same).select("l.*", "r._a").where((F.col("signal_pos") - F.col("_a")) % F.col("horizon") == 0).drop("_a")
    df = df.join(F.broadcast(cal.agg(F.max("pos").alias("last"))))
    end = F.col("signal_pos") + F.col("horizon")
    df = df.withColumns({"start": F.col("signal_pos") + 1, "end": F.least(end, F.col("last")) if overlapping else end})
    return df.where("start <= end and end <= last")


def coded(sig: DataFrame, keys: list[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """``sig`` with a number g for its group, and the names (g, keys): positions are exploded and sorted by numbers, not by text."""
    names = stored(sig.select(*keys).distinct().withColumn("g", F.row_number().over(Window.orderBy(*keys))))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    return sig.alias("s").join(F.broadcast(names.alias("n")), same).select("s.*", "n.g").drop(*keys), names


#: Positions of a task: their days, some six for each, and those days' sums are what a task holds.
TASK_POSITIONS = 1 << 17


def tasks(sig: DataFrame) -> int:
    """Partitions for work by code: more of them for more positions (a stored table's count reads no rows)."""
    return max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sig.count() // TASK_POSITIONS))


def executed(sig: DataFrame, d: DataFrame, n: int, short: bool = False) -> DataFrame:
    """A row for each code and signal day with the distinct ``tags`` (g, decile) that hold it, and ``open`` (can be opened on the first day), ``unknown`` (no row or return there) and ``exit`` (null: never closed).

    What happens to a position depends on its code and days alone, so groups and deciles ride along. A code's positions
    and days meet in one of ``n`` partitions and stay there: what a day holds is looked up by windows over both.
    """
    blocked = F.col("down") if short else F.col("up")
    held = F.col("up") if short else F.col("down")
    free = (F.col("susp") == 0) & (held == 0)
    can = (F.col("susp") == 0) & F.coalesce(blocked == 0, F.lit(False)) & F.col("o2c").isNotNull() & (F.col("vol") > 0)
    days = d.select("code", F.col("pos").alias("at"), F.struct(F.coalesce(can, F.lit(False)).alias("can"), F.col("o2c").isNull().alias("unknown")).alias("_first"), F.when(free & F.col("ret").isNotNull(), F.col("pos")).alias("_sell"), (free & F.col("o2c").isNotNull()).alias("_same"))
    keys = ["code", "signal_pos", "horizon", "start", "end", "last"]
    asked = sig.select(*keys, "g", "decile").repartition(n, "code").groupBy(*keys).agg(F.collect_set(F.struct("g", "decile")).alias("tags"))
    df = days.repartition(n, "code").unionByName(asked.withColumn("at", F.col("start")), allowMissingColumns=True)
    df = df.withColumn("_d", F.max("_first").over(Window.partitionBy("code", "at")))
    df = df.withColumns({"open": F.coalesce(F.col("_d.can"), F.lit(False)), "unknown": F.coalesce(F.col("_d.unknown"), F.lit(True)), "at": F.coalesce("end", "at")}).drop("_first", "_d")
    # the first day from each one on, on which the code can be sold: one pass over the code's days, the last first
    back = Window.partitionBy("code").orderBy(F.desc("at"))
    first, after = (F.min("_sell").over(back.rangeBetween(Window.unboundedPreceding, until)) for until in (0, -1))
    same = F.max("_same").over(back.rangeBetween(0, 0))
    # sold on its first day, a position asks for the return from open to close
    df = df.withColumns({"_exit": first, "_after": after, "_now": same})
    exit = F.when(F.col("start") == F.col("end"), F.when(F.col("_now"), F.col("end")).otherwise(F.col("_after"))).otherwise(F.col("_exit"))
    return df.where("tags is not null").select(*keys, "tags", "open", "unknown", exit.alias("exit"))


#: What a cohort, or a day on which some of it leave late, takes in a task.
COHORT_BYTES = 64


def cohorts(pos: DataFrame) -> DataFrame:
    """(g, decile, signal_pos): positions, those opened, and how many of these leave late on which day.

    Late exits are counted by day: an array of as many entries as there are such days, however many positions leave on one.
    """
    late = F.col("open") & (F.col("gone") > F.col("end"))
    days = pos.select("signal_pos", "open", F.when(late, F.col("gone")).alias("gone"), F.inline("tags")).groupBy("g", "decile", "signal_pos", "gone").agg(F.count("*").alias("n"), F.count_if("open").alias("k"))
    of = F.collect_list(F.when(F.col("gone").isNotNull(), F.struct("gone", F.col("n").alias("_same"))))
    return days.groupBy("g", "decile", "signal_pos").agg(F.sum("n").alias("n_all"), F.sum("k").alias("n_open"), of.alias("late"))


def held_days(pos: DataFrame, d: DataFrame, overlapping: bool, n: int) -> DataFrame:
    """(g, decile, pos, code): each book's weight at the day's start (null: not held) and whether it opens then, the day's returns, and counts of what opens and is due.

    ``ideal`` holds all positions to their target, ``constrained`` those that could be opened, ``actual`` these until
    they can be sold. Overlapping: each cohort's slot of 1/H is shared by those alive in it. Otherwise weights stay as
    they were at the start. How many are alive follows from the cohort's size and its late exits, so it is worked out
    for positions. A code's positions and days meet in one of ``n`` partitions; there they are exploded over their
    days, for all books and groups at once, and added up, so exploded rows are neither sent nor written.
    """
    pos = stored(pos.withColumn("gone", F.coalesce("exit", F.lit(1 << 60))))
    sizes = stored(cohorts(pos))
    until = F.when(F.col("open"), F.greatest(F.col("end"), F.least(F.col("gone"), F.col("last")))).otherwise(F.col("end"))
    slot = (1 / F.col("horizon")) if overlapping else F.lit(1.0)
    asked = pos.select("code", "signal_pos", "start", "end", "open", "unknown", "gone", "tags", slot.alias("slot"), until.alias("until"))
    days = d.select("code", F.col("pos").alias("start"), F.col("pos").alias("until"), F.struct("ret", "o2c", "susp").alias("_day"))
    df = asked.unionByName(days, allowMissingColumns=True).repartition(n, "code").select("*", F.explode(F.sequence("start", "until")).alias("pos"))
    df = df.withColumn("_day", F.max("_day").over(Window.partitionBy("code", "pos"))).where("tags is not null")
    df = df.select("pos", "code", "signal_pos", "start", "end", "open", "unknown", "gone", "slot", "_day.*", F.inline("tags"))
    small = F.broadcast(sizes) if sizes.count() * GROUP_BYTES <= BROADCAST_BYTES else sizes
    df = df.join(small, ["g", "decile", "signal_pos"])
    day, slot, n_open = F.col("pos"), F.col("slot"), F.col("n_open")
    later = lambda k: F.aggregate(F.filter("late", lambda x: x["gone"] > k), F.lit(0).cast("long"), lambda n, x: n + x["_same"])
    planned, due, opens = day <= F.col("end"), day >= F.col("end"), F.col("start") == day
    on = {"ideal": planned, "constrained": F.col("open") & planned, "actual": F.col("open") & (day <= F.col("gone"))}
    df = df.withColumns({"_alive": F.when(planned, n_open).otherwise(later(day - 1)), "_stay": F.when(due, later(day)).otherwise(n_open) if overlapping else n_open}).drop("late")
    alive, kept = F.col("_alive"), F.col("_stay")
    w = {"ideal": slot / F.col("n_all"), "constrained": slot / n_open, "actual": slot / (alive if overlapping else n_open)}
    stays = on["actual"] & (F.col("gone") > day)
    count = lambda c: F.sum(c.cast("int"))
    return df.groupBy("g", "decile", "pos", "code").agg(
        *[F.sum(F.when(on[b], w[b])).alias(f"{b}_w") for b in BOOKS], *[F.max(on[b] & opens).alias(f"{b}_opens") for b in BOOKS], F.sum(F.when(stays, slot / kept).otherwise(0.0)).alias("w_end"), F.sum(F.when(on["actual"], 1 / alive)).alias("share"),
        count(due & stays).alias("blocked"), count(on["actual"] & due & ~opens).alias("due"), count(on["actual"] & due & opens).alias("due_first"), count(opens & ~F.col("open")).alias("not_opened"), count(opens & F.col("unknown")).alias("not_known"), *[F.max(c).alias(c) for c in ("ret", "o2c", "susp")],
    )


def _sums(held: DataFrame) -> list[Column]:
    """Aggregates of ``book_days``."""
    out = []
    for b in BOOKS:
        r = F.when(F.col(f"{b}_opens"), F.col("o2c")).otherwise(F.col("ret"))
        r = F.when(r.isNull() & (F.col("susp") == 1), 0.0).otherwise(r)
        w = F.col(f"{b}_w")
        weight = F.sum(F.when(r.isNotNull(), w))
        out += [safe_div(F.sum(w * r), F.when(weight > 0, weight)).alias(f"{b}_return"), weight.alias(f"{b}_valid"), F.sum(F.when(r.isNull(), w)).alias(f"{b}_missing"), F.count_if(w.isNotNull() & r.isNull()).alias(f"{b}_unknown"), F.nullif(F.count(w), F.lit(0)).alias(f"{b}_holdings")]
    due_unknown = F.when(F.col("o2c").isNull(), F.col("due_first")).otherwise(0) + F.when(F.col("ret").isNull(), F.col("due")).otherwise(0)
    return [*out, F.round(F.sum("share")).cast("long").alias("actual_cohorts"), F.sum("blocked").alias("actual_blocked"), F.sum(due_unknown).alias("actual_due_unknown"), F.sum("not_opened").alias("ideal_not_opened"), F.sum("not_known").alias("ideal_not_known")]


def book_days(held: DataFrame) -> DataFrame:
    """One row for each BOOK and day: each book's return by valid weight, valid and missing weight and counts, under its name; null holdings: none."""
    return held.groupBy(*CODED, "pos").agg(*_sums(held))


def _moves(held: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``held`` with w and w_end as they change, and the aggregates of that: opening and closing on a day, leaving by the next one.

    A code's days lie in one task already, so that sorts them there and sends nothing.
    """
    own = Window.partitionBy(*CODED, "code").orderBy("pos")
    before = F.when(F.lag("pos").over(own) == F.col("pos") - 1, F.lag("w_end").over(own))
    gone = F.coalesce(F.lead("pos").over(own), F.lit(-1)) != F.col("pos") + 1
    df = held.withColumns({"_before": F.coalesce(before, F.lit(0.0)), "_gone": gone})
    return df, [F.sum(F.abs(F.col("w") - F.col("_before"))).alias("_opening"), F.sum(F.abs(F.col("w_end") - F.col("w"))).alias("end_turnover"), F.sum(F.when(F.col("_gone"), F.abs("w_end"))).alias("_leaving")]


def _turned(days: DataFrame) -> DataFrame:
    """Sums of ``_moves`` by day, with start_turnover: what opens, and what left with the day before and isn't held any more."""
    left = days.select(*CODED, (F.col("pos") + 1).alias("pos"), F.col("_leaving").alias("_left"))
    return days.drop("_leaving").join(left, [*CODED, "pos"], "left").withColumn("start_turnover", _zero("_opening") + _zero("_left")).drop("_opening", "_left")


def turned_days(held: DataFrame) -> DataFrame:
    """``book_days`` with the turnover of the actual book, in one pass over what is held."""
    df, moves = _moves(held.withColumn("w", _zero("actual_w")))
    return _turned(stored(df.groupBy(*CODED, "pos").agg(*_sums(df), *moves)))


def portfolio_sums(pos: DataFrame, d: DataFrame, overlapping: bool, n: int) -> DataFrame:
    """``turned_days`` of ``held_days``; by arrays, unless there are so many cohorts that their sizes don't go to every task."""
    pos = stored(pos.withColumn("gone", F.coalesce("exit", F.lit(1 << 60))))
    sizes = stored(cohorts(pos))
    if sizes.agg(F.count("*") + F.coalesce(F.sum(F.size("late")), F.lit(0))).first()[0] * COHORT_BYTES > BROADCAST_BYTES:
        return turned_days(held_days(pos, d, overlapping, n))
    days = stored(books.summed_days(pos, d, sizes.collect(), overlapping))
    return _turned(days.withColumn("decile", F.col("decile").cast(sizes.schema["decile"].dataType)))


def actual(held: DataFrame, sign: int = 1) -> DataFrame:
    """Weights of the actual book at each day's start and end."""
    return held.where("actual_w is not null").select(*CODED, "pos", "code", (sign * F.col("actual_w")).alias("w"), (sign * F.col("w_end")).alias("w_end"))


def turnover(held: DataFrame) -> DataFrame:
    """Sums of absolute weight changes: overnight into a day's start, and from its start to its end."""
    df, moves = _moves(held)
    return _turned(stored(df.groupBy(*CODED, "pos").agg(*moves)))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _loss(a: str, b: str, overlapping: bool) -> Column:
    return _zero(a) - _zero(b) if overlapping else F.col(a) - F.col(b)


def _count(*columns: str) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def portfolio_days(pred: DataFrame, features: DataFrame | Placed, cfg: EngineConfig, overlapping: bool = True) -> DataFrame:
    """One row for each group, decile and day on which any of the three books holds something, before costs."""
    cal, d = placed(features)
    sig, names = coded(stored(signals(pred, cal, overlapping)))
    n = tasks(sig)
    df = portfolio_sums(executed(sig, d, n), d, overlapping, n)
    first = sig.groupBy("g").agg(F.min("start").alias("_first"), F.max("horizon").alias("_h"))
    df = df.where("ideal_holdings is not null or actual_holdings is not null").join(F.broadcast(first.join(names, "g")), "g").join(F.broadcast(cal), "pos")
    # a book without positions has a return of 0; one whose positions are all unknown has none
    for b in BOOKS:
        df = df.withColumn(f"{b}_return", F.when(F.col(f"{b}_holdings").isNull(), 0.0).otherwise(F.col(f"{b}_return")))
    return df.select(
        "date", *BOOK, F.concat(F.lit("D"), F.col("decile").cast("string")).alias("portfolio_name"), F.col("actual_return").alias("gross_return"), (_zero("start_turnover") + _zero("end_turnover")).alias("turnover"), _zero("start_turnover").alias("start_turnover"), _zero("end_turnover").alias("end_turnover"),
        _count("actual_cohorts").alias("active_cohorts"), _count("actual_holdings").alias("num_holdings"), _count("ideal_not_opened").alias("num_blocked_buys"), _count("actual_blocked").alias("num_blocked_sells"), _count("actual_blocked").alias("num_forced_holds"),
        _count("actual_unknown", "ideal_not_known", "actual_due_unknown").alias("num_data_missing_returns"), _zero("actual_valid").alias("valid_weight"), _zero("actual_missing").alias("missing_weight"), _zero("ideal_valid").alias("signal_valid_weight"), _zero("ideal_missing").alias("signal_missing_weight"),
        F.col("ideal_return").alias("signal_gross_alpha"), F.col("constrained_return").alias("buy_constrained_gross_return"), _loss("ideal_return", "constrained_return", overlapping).alias("buy_blocked_loss"), _loss("constrained_return", "actual_return", overlapping).alias("sell_blocked_forced_hold_loss"),
        ((F.col("pos") - F.col("_first") + 1 < F.col("_h")) if overlapping else F.lit(False)).alias("is_warmup"),
    )


def long_short_days(pred: DataFrame, features: DataFrame | Placed, top: int = 10, bottom: int = 1) -> DataFrame:
    """The non-overlapping long-short book of each group and day: long the top decile, short the bottom one, in all three books.

    Returns are long less short where both legs have one, weights the smaller of both, counts their sums, turnover that of netted weights.
    """
    cal, d = placed(features)
    sig, names = coded(stored(signals(pred, cal, False).where(F.col("decile").isin(top, bottom))))
    n, legs = tasks(sig), {}
    for name, sign, decile in (("long", 1, top), ("short", -1, bottom)):
        held = held_days(executed(sig.where(F.col("decile") == decile), d, n, short=sign < 0), d, False, n)
        legs[name] = stored(held.withColumn("decile", F.lit(0)))
    days = {n: book_days(h) for n, h in legs.items()}
    sides = [df.select(*CODED, "pos", *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in (*CODED, "pos")]) for n, df in days.items()]
    net = actual(legs["long"]).union(actual(legs["short"], -1)).groupBy(*CODED, "pos", "code").agg(F.sum("w").alias("w"), F.sum("w_end").alias("w_end"))
    count = net.groupBy(*CODED, "pos").agg(F.count("*").alias("num_holdings"))
    df = sides[0].join(sides[1], [*CODED, "pos"], "full").join(turnover(net), [*CODED, "pos"], "left").join(count, [*CODED, "pos"], "left").join(F.broadcast(names), "g").join(F.broadcast(cal), "pos")
    spread = lambda b: F.when((_zero(f"long_{b}_valid") > 0) & (_zero(f"short_{b}_valid") > 0), F.col(f"long_{b}_return") - F.col(f"short_{b}_return"))
    df = df.withColumns({f"{b}_return": spread(b) for b in BOOKS})
    both = lambda *names: _count(*[f"{s}_{n}" for s in legs for n in names])
    less = lambda c: F.least(_zero(f"long_{c}"), _zero(f"short_{c}"))
    return df.where("num_holdings is not null").select(
        "date", *BOOK, F.lit(f"D{top}_minus_D{bottom}").alias("portfolio_name"), F.col("actual_return").alias("gross_return"), (_zero("start_turnover") + _zero("end_turnover")).alias("turnover"), _zero("start_turnover").alias("start_turnover"), _zero("end_turnover").alias("end_turnover"),
        F.col("num_holdings").cast("long").alias("num_holdings"), both("ideal_not_opened").alias("num_blocked_buys"), both("actual_blocked").alias("num_blocked_sells"), both("actual_blocked").alias("num_forced_holds"), both("actual_unknown", "ideal_not_known", "actual_due_unknown").alias("num_data_missing_returns"),
        less("actual_valid").alias("valid_weight"), F.greatest(_zero("long_actual_missing"), _zero("short_actual_missing")).alias("missing_weight"), less("ideal_valid").alias("signal_valid_weight"), F.greatest(_zero("long_ideal_missing"), _zero("short_ideal_missing")).alias("signal_missing_weight"),
        F.col("ideal_return").alias("signal_gross_alpha"), F.col("constrained_return").alias("buy_constrained_gross_return"), _loss("ideal_return", "constrained_return", False).alias("buy_blocked_loss"), _loss("constrained_return", "actual_return", False).alias("sell_blocked_forced_hold_loss"), F.lit(False).alias("is_warmup"),
    )


def holdings(pred: DataFrame, features: DataFrame | Placed, top: int = 10, bottom: int = 1, cal: DataFrame | None = None) -> DataFrame:
    """What each rebalance opens: three rows, D10 long, D10_minus_D1 long and short, with their codes.

    Opening depends on the first day's row alone, so positions of both deciles meet just the rows of first days, by code and
    day; nothing else of the daily rows is sent, and a leg that two portfolios hold is gathered once.
    """
    cal = trading_days(features) if cal is None else cal
    keys = ["horizon", "signal_pos", "start", "end"]
    sig = signals(pred, cal, False)
    cycles = stored(sig.groupBy(*GROUP, *keys).agg(F.count_if(F.col("decile").isin(top, bottom)).alias("_n")))
    cycles, names = coded(cycles)
    n = max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(cycles.agg(F.sum("_n")).first()[0] or 0) // TASK_POSITIONS))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in GROUP]
    asked = sig.where(F.col("decile").isin(top, bottom)).alias("s").join(F.broadcast(names.alias("n")), same).select("code", F.col("start").alias("pos"), "g", *keys, "decile")
    can = (F.col("susp") == 0) & F.col("o2c").isNotNull() & (F.col("vol") > 0)
    days = opening_days(features, cal, cycles.select(F.col("start").alias("pos")).distinct(), n).where(can).select("code", "pos", (F.col("up") == 0).alias("_long"), (F.col("down") == 0).alias("_short"))
    opened = asked.repartition(n, "code", "pos").join(days, ["code", "pos"]).where(F.when(F.col("decile") == top, F.col("_long")).otherwise(F.col("_short")))
    opened = opened.groupBy("g", *keys, "decile").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    legs = [F.struct(F.lit(p).alias("portfolio_name"), F.lit(leg).alias("leg"), F.lit(d).cast(pred.schema["decile"].dataType).alias("decile")) for p, leg, d in (("D10", "long", top), ("D10_minus_D1", "long", top), ("D10_minus_D1", "short", bottom))]
    df = cycles.select("g", *keys, F.inline(F.array(*legs))).join(opened, ["g", *keys, "decile"], "left").join(F.broadcast(names), "g")
    df = df.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    for c, new in (("signal_pos", "signal_date"), ("start", "rebalance_date"), ("end", "target_end_date")):
        df = df.join(F.broadcast(cal.select(F.col("pos").alias(c), F.col("date").alias(new))), c)
    return df.select("signal_date", "rebalance_date", "target_end_date", "horizon", *GROUP, "portfolio_name", "leg", F.size("codes").alias("n_holdings"), "codes")


def holding_overlap(held: DataFrame) -> DataFrame:
    """Logistic against CNN holdings of the same rebalance, side by side by one grouping; of several models of a family the first by name."""
    from tapeline.functions.exprs import join_codes, model_family

    keys = ["experiment_name", "universe_group", "portfolio_name", "leg", "rebalance_date"]
    sides = ("signal_date", "target_end_date", "horizon")
    own, family = F.struct(*sides, "codes", "model_name"), F.col("_f")
    first = lambda f: F.min_by(F.when(family == f, own), F.when(family == f, F.struct("model_name", "signal_date")))
    df = held.withColumn("_f", model_family(F.col("model_name"))).where("_f is not null").dropna(subset=keys)
    df = df.groupBy(*keys).agg(first("Logistic").alias("_a"), first("CNN").alias("_b")).where("_a is not null and _b is not null")
    of = {"logistic": F.col("_a"), "cnn": F.col("_b")}
    df = df.select(*keys, *[x[c].alias(f"{c}_{f}") for c in sides for f, x in of.items()], *[x["model_name"].alias(f"{f}_model") for f, x in of.items()], of["logistic"]["codes"].alias("a"), of["cnn"]["codes"].alias("b"))
    both, either = F.array_intersect("a", "b"), F.array_union("a", "b")
    return df.select(*keys, *[f"{c}_{f}" for c in sides for f in ("logistic", "cnn")], "logistic_model", "cnn_model", F.size("a").alias("logistic_n"), F.size("b").alias("cnn_n"), F.size(both).alias("intersection_n"), F.size(either).alias("union_n"), safe_div(F.size(both), F.size(either)).alias("jaccard_overlap"), safe_div(F.size(both), F.size("a")).alias("logistic_coverage"), safe_div(F.size(both), F.size("b")).alias("cnn_coverage"), join_codes(both).alias("intersection_codes"))


def overlap_summary(overlap: DataFrame) -> DataFrame:
    j = F.col("jaccard_overlap")
    return overlap.groupBy("experiment_name", "universe_group", "portfolio_name", "leg").agg(F.count("*").alias("n_rebalances"), F.avg(j).alias("jaccard_mean"), F.median(j).alias("jaccard_median"), F.percentile(j, F.lit(0.25)).alias("jaccard_p25"), F.percentile(j, F.lit(0.75)).alias("jaccard_p75"), *[F.avg(c).alias(f"avg_{c}") for c in ("intersection_n", "logistic_n", "cnn_n")])


def compounding_check(pred: DataFrame, features: DataFrame | Placed, check_rows: int | None = None) -> DataFrame:
    """Future returns rebuilt from daily ones for all rows, or the first ``check_rows`` by date and code: (1 + open-to-close) * product of (1 + ret), against future_ret.

    Each code's days carry running sums: of the logarithms of the factors' sizes, and of how many factors were zero, negative and
    known. A horizon's product is the difference of two of them, so its cost is two lookups, however long it is.
    """
    cal, d = placed(features)
    rows = pred.select("date", "code", "horizon", "future_ret").distinct()
    rows = rows if check_rows is None else rows.orderBy("date", "code").limit(check_rows)
    factor = 1 + F.col("ret")
    so_far = Window.partitionBy("code").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"logs": F.sum(F.when(factor != 0, F.ln(F.abs(factor)))), "zeros": F.sum((factor == 0).cast("int")), "signs": F.sum((factor < 0).cast("int")), "known": F.count("ret")}
    days = stored(d.select("code", "pos", "o2c", *[F.coalesce(v.over(so_far), F.lit(0)).alias(k) for k, v in sums.items()]))
    end = days.select("code", F.col("pos").alias("end"), *[F.col(k).alias(f"end_{k}") for k in sums])
    rows = rows.join(F.broadcast(cal), "date").withColumns({"first": F.col("pos") + 1, "end": F.col("pos") + F.col("horizon")}).drop("pos")
    rows = rows.join(days.withColumnRenamed("pos", "first"), ["code", "first"]).join(end, ["code", "end"])
    of = {k: F.col(f"end_{k}") - F.col(k) for k in sums}
    size = F.when(of["zeros"] > 0, 0.0).otherwise(F.exp(of["logs"]) * F.when(of["signs"] % 2 == 1, -1.0).otherwise(1.0))
    rows = rows.where(F.col("o2c").isNotNull() & (of["known"] == F.col("horizon") - 1))
    rebuilt = (1 + F.col("o2c")) * size - 1
    return rows.agg(F.count("*").alias("n_rows"), F.max(F.abs(rebuilt - F.col("future_ret"))).alias("max_difference"))


def warned(check: DataFrame, tolerance: float) -> str | None:
    """A warning from the row of ``compounding_check``: nothing to compare, or a difference above the tolerance; None if all is well."""
    row = check.first()
    if not row.n_rows:
        return "compounding check: no row has all its daily returns"
    if row.max_difference is not None and row.max_difference > tolerance:
        return f"compounding check: of {row.n_rows} rows one differs by {row.max_difference:.8g}, more than {tolerance:g}"
    return None
