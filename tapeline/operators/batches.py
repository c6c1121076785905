"""Batches of rows by date, for training loops: the same batches whatever the partitions of the input.

A batch holds rows of one date, in order of code; batches are numbered in order of date. A date of more rows than a batch may
have is cut into several. Places within dates are exact ranks (operators.order), and numbers follow from the dates' counts, a
few thousand rows, so nothing is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.order import Store, ranked
from tapeline.sinks.stored import stored


def date_batches(df: DataFrame, most: int, keys: tuple[str, ...] = ("code",), store: Store = stored) -> DataFrame:
    """``df`` with batch and place, both from 0; rows without a date belong to none and go.

    ``keys`` tell rows of a date apart; rows that they don't tell apart lie in one batch or follow each other, in no fixed order.
    """
    if most < 1:
        raise ValueError("a batch has a row at least")
    known = store(df.where("date is not null"))
    sizes = known.groupBy("date").agg(F.ceil(F.count("*") / most).alias("_n"))  # a row for each date
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("date", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    out = ranked(known, ["date"], list(keys), "_k", store).join(F.broadcast(first), "date")
    return out.withColumns({"batch": F.col("_first") + F.floor((F.col("_k") - 1) / most), "place": (F.col("_k") - 1) % most}).drop("_first", "_k")


def dealt(batched: DataFrame, partitions: int) -> DataFrame:
    """Batches dealt to partitions by number, whole and in order in each: a loop over a partition meets batch after batch."""
    return batched.repartition(partitions, F.pmod(F.col("batch"), F.lit(partitions))).sortWithinPartitions("batch", "place")
