"""Candlestick images of price windows, as a relation of lit pixels and as dense bytes.

A window is its day's row and the w - 1 rows before it. A day has three columns: the open's pixel, a bar
from low to high, the close's pixel; a moving average runs through the middle columns; below, bars of
volume stand on the bottom, a pixel high at least.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.config import EngineConfig, image_shape
from tapeline.functions.exprs import pixel_row, safe_div


def windows(df: DataFrame, window: int, cfg: EngineConfig) -> DataFrame:
    """Valid windows: date, code, p_min, p_max, amount_max and ``days``, an array of (open, high, low, close, amount, ma).

    Valid are tradable rows with w complete rows, a known return at one horizon at least, a price range and some amount.
    """
    span = Window.partitionBy("code").orderBy("date").rowsBetween(-(window - 1), 0)
    ma = F.when(F.count("close_adj").over(span) == window, F.avg("close_adj").over(span))
    df = df.withColumn("_ma", ma)
    fields = {"o": "open_adj", "h": "high_adj", "l": "low_adj", "c": "close_adj", "a": "amount", "m": "_ma"}
    whole = F.lit(True)
    for c in fields.values():
        whole = whole & F.col(c).isNotNull()
    some = F.lit(False)
    for h in cfg.horizons_of_window(window):
        some = some | F.col(f"future_ret_{h}d").isNotNull()
    df = df.withColumn("_day", F.struct(*[F.col(c).cast("double").alias(k) for k, c in fields.items()])).withColumns({
        "p_max": F.max(F.greatest("high_adj", "_ma")).over(span), "p_min": F.min(F.least("low_adj", "_ma")).over(span), "amount_max": F.max("amount").over(span),
        "_full": F.sum(whole.cast("int")).over(span), "days": F.collect_list("_day").over(span),
    })
    keep = ["date", "code", "p_min", "p_max", "amount_max", "days", *[f"{p}_{h}d" for h in cfg.horizons_of_window(window) for p in ("label", "future_ret")]]
    return df.where(some & (F.col("is_tradable") == 1) & (F.col("_full") == window) & (F.col("p_max") > F.col("p_min")) & (F.col("amount_max") > 0)).select(*keep)


def _let(value: Column, use) -> Column:
    """The elements of the array ``use(value)``, with ``value`` worked out once."""
    return F.flatten(F.transform(F.array(value), use))


def _line(x0: Column, x1: Column, ends: Column, place) -> Column:
    """Places of a line between the rows ``ends`` (a, b): as many points as the longer side needs, half-even rounding."""

    def points(e: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), e["n"]), lambda i: place(F.rint(x0 + i * e["dx"]).cast("int"), F.rint(e["a"] + i * e["dy"]).cast("int")))

    n = F.greatest(F.abs(x1 - x0), F.abs(ends["b"] - ends["a"]))
    steps = F.struct(ends["a"].alias("a"), n.alias("n"), safe_div(x1 - x0, n).alias("dx"), safe_div(ends["b"] - ends["a"], n).alias("dy"))
    return _let(steps, points)


def pixels(valid: DataFrame, window: int, cfg: EngineConfig) -> DataFrame:
    """date, code and the sorted distinct lit pixels (x, y), y from the top.

    A pixel is a number, x * height + y, until the end, as numbers are told apart by a hash table and sorted as such; and a day's rows are worked out once.
    """
    height, width, price, volume = image_shape(window, cfg.day_width)
    row = lambda p: pixel_row(p, F.col("p_min"), F.col("p_max"), price)
    step = cfg.day_width
    place = lambda x, y: x * height + y

    def rows(d: Column) -> Column:
        tall = F.rint(safe_div(d["a"], F.col("amount_max")) * (volume - 1)).cast("int") + 1
        return F.struct(*[row(d[c]).alias(c) for c in "ohlcm"], tall.alias("tall"))

    def day(d: Column, i: Column) -> Column:
        x = i * step
        bar = F.transform(F.sequence(d["h"], d["l"]), lambda y: place(x + 1, y))
        flow = F.flatten(F.transform(F.sequence(F.lit(0), d["tall"] - 1), lambda k: F.array(*[place(x + j, F.lit(height - 1) - k) for j in range(step)])))
        return F.concat(F.array(place(x, d["o"]), place(x + 2, d["c"])), bar, flow)

    def average(i: Column) -> Column:
        ends = F.struct(F.get("_rows", i)["m"].alias("a"), F.get("_rows", i + 1)["m"].alias("b"))
        return _let(ends, lambda e: _line((i * step + 1).cast("int"), ((i + 1) * step + 1).cast("int"), e, place))

    marks = F.flatten(F.transform("_rows", day))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(window - 2)), average)) if window > 1 else F.array().cast("array<int>")
    others = [c for c in valid.columns if c.startswith(("label_", "future_ret_"))]
    df = valid.select("date", "code", *others, "p_min", "p_max", "amount_max", "days").withColumn("_rows", F.transform("days", rows))
    xy = lambda v: F.struct(F.floor(v / height).cast("int").alias("x"), (v % height).alias("y"))
    return df.select("date", "code", F.transform(F.sort_array(F.array_distinct(F.concat(marks, lines))), xy).alias("pixels"), *others)


def dense(lit: DataFrame, window: int, cfg: EngineConfig) -> DataFrame:
    """``image``: height * width bytes, 0 or white, row by row."""
    height, width, _, _ = image_shape(window, cfg.day_width)
    lit = lit.withColumn("_places", F.sort_array(F.transform("pixels", lambda p: p["y"] * width + p["x"])))
    # runs of dark bytes between lit ones, in hexadecimal; the places are a column, as a lambda works its expressions out anew for each element
    gaps = F.transform("_places", lambda v, i: F.concat(F.repeat(F.lit("00"), v - F.when(i == 0, -1).otherwise(F.get("_places", i - 1)) - 1), F.lit("FF")))
    text = F.rpad(F.array_join(gaps, ""), 2 * height * width, "0")
    return lit.withColumn("image", F.unhex(text)).drop("pixels", "_places")


#: Bytes of images that a task draws at once.
DRAWN_BYTES = 4 << 20


def drawn(valid: DataFrame, window: int, cfg: EngineConfig) -> DataFrame:
    """What ``dense(pixels(valid))`` gives, drawn for many windows at once by array operations: each of them takes its pixel of all windows.

    A batch of windows is drawn a few megabytes of images at a time, so images of any size take the same memory.
    """
    height, width, price, volume = image_shape(window, cfg.day_width)
    step, size, white = cfg.day_width, height * width, 255
    others = [c for c in valid.columns if c.startswith(("label_", "future_ret_"))]

    def draw(np, days, low, high, most):
        """Images of windows: ``days`` are six arrays of a row for each window and a column for each day."""
        n = len(low)
        out = np.zeros((n, height, width), np.uint8)
        flat, base = out.reshape(-1), np.arange(n)[:, None] * size
        with np.errstate(all="ignore"):
            rows = {k: np.fmax(0.0, np.fmin(price - 1.0, np.rint((high - days[k]) / (high - low) * (price - 1)))).astype(np.int64) for k in "ohlcm"}
            tall = np.rint(days["a"] / most * (volume - 1)).astype(np.int64) + 1
        x = np.arange(window)[None, :] * step
        flat[base + rows["o"] * width + x] = white
        flat[base + rows["c"] * width + x + 2] = white
        top, end = np.minimum(rows["h"], rows["l"]), np.maximum(rows["h"], rows["l"])
        at, up = np.arange(price)[None, :, None], np.arange(volume)[None, ::-1, None]
        out[:, :price, 1::step] |= ((at >= top[:, None, :]) & (at <= end[:, None, :])).view(np.uint8) * np.uint8(white)
        out[:, height - volume :, :] = np.repeat((up < tall[:, None, :]).view(np.uint8) * np.uint8(white), step, axis=2)
        for i in range(window - 1):
            a, b = rows["m"][:, i, None], rows["m"][:, i + 1, None]
            points = np.maximum(step, np.abs(b - a))
            k = np.minimum(np.arange(points.max() + 1)[None, :], points)  # a shorter line ends in its last point
            px, py = np.rint(i * step + 1 + k * (step / points)).astype(np.int64), np.rint(a + k * ((b - a) / points)).astype(np.int64)
            flat[base + py * width + px] = white
        return out

    def images(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            each_day = batch.column("days").flatten()
            days = {f.name: np.asarray(c).reshape(-1, window) for f, c in zip(each_day.type, each_day.flatten())}
            low, high, most = (np.asarray(batch.column(c), dtype=np.float64)[:, None] for c in ("p_min", "p_max", "amount_max"))
            each = max(1, DRAWN_BYTES // size)
            for i in range(0, batch.num_rows, each):
                part = slice(i, i + each)
                made = draw(np, {k: v[part] for k, v in days.items()}, low[part], high[part], most[part])
                n = len(made)
                image = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(made)])
                kept = batch.slice(i, each).select(["date", "code", *others])
                yield pa.RecordBatch.from_arrays([*kept.columns, image], names=[*kept.schema.names, "image"])

    kept = valid.select("date", "code", *others)
    return valid.select("date", "code", *others, "p_min", "p_max", "amount_max", "days").mapInArrow(images, kept.withColumn("image", F.lit(None).cast("binary")).schema)
