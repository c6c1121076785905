"""Target-distribution importance resampling by position-table n-grams, in DataFrame operations only.

The words of all documents are exploded with their positions; the following words of the same document, by lead() over
the positions, make the runs of 1 to ``orders`` words, and crc32 puts each into one of ``buckets``. Counts of the
buckets, over all documents and over all texts of the target, give each bucket's gain: how much likelier the target is to
have it, as a whole number of thousandths of a natural logarithm. A document's weight is the sum of its runs' gains. Weight plus
Gumbel noise from a hash of the id is its score, and the highest scores are a draw without replacement in proportion to the
exponential of the weights.

A document's row is sent to one task whole before it is exploded, so the window needs no exchange of words, and rows
of one id are different documents. The buckets of all positions are kept as a table, of which counts and weights are
sums. The gains are a table of ``buckets`` rows at most, so their broadcast is bounded. Ranks come from counts of sampled ranges
of the scores (operators.order), never from one sorted task.

Defined cases: null texts are empty, and empty ones have no runs and weight 0; rows with few words are weighed but not
drawn; equal scores go by id, nulls first, then by row, and equal rows are drawn one by one; a null id has the hash of the
empty text; very long texts are one window, which Spark spills; an empty table gives no rows, with an empty
target only the buckets' rarity counts; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.order import ranked

from .dist import Scratch

ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters, with A-Z alone in lower case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower())), _DELIMITERS), "")


def positions(docs: DataFrame, text: str, ident: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``ident`` and _row of each document with b1, b2, ...: the buckets of the runs that start at each word; nulls where none does."""
    own = docs.select(*ident, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")).repartition("_row")
    table = own.select(*ident, "_row", F.posexplode_outer(words(F.col("_text"))).alias("_at", "_w"))
    ahead = Window.partitionBy("_row").orderBy("_at")
    table = table.withColumns({f"_w{k}": F.lead("_w", k).over(ahead) for k in range(1, orders)})
    run = [F.col("_w"), *[F.col(f"_w{k}") for k in range(1, orders)]]
    bucket = {}
    for k in range(1, orders + 1):
        joined = F.concat(*[x for c in run[:k] for x in (F.lit(" "), c)][1:])  # null where a word is missing
        bucket[f"b{k}"] = (F.crc32(F.encode(joined, "UTF-8")) % buckets).cast("int")
    return table.select(*ident, "_row", *[v.alias(k) for k, v in bucket.items()])


def _runs(table: DataFrame, *keep: str) -> DataFrame:
    """A row for each run: its bucket b."""
    return table.select(*keep, F.explode(F.array_compact(F.array(*[c for c in table.columns if c[0] == "b"]))).alias("b"))


def gains(raw: DataFrame, target: DataFrame, scratch: Scratch, buckets: int = BUCKETS) -> DataFrame:
    """(b, gain) of the buckets that ``raw`` has, from the runs of both; at most ``buckets`` rows."""
    n = raw.groupBy("b").agg(F.count("*").alias("s")).join(target.groupBy("b").agg(F.count("*").alias("t")), "b", "full")
    n = scratch.table(n.select("b", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))  # the totals are read first
    total = n.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()  # one row
    share = (F.col("t") + 1).cast("double") * float(total["all_s"] + buckets) / ((F.col("s") + 1).cast("double") * float(total["all_t"] + buckets))
    return n.where("s > 0").select("b", F.floor(1000 * F.log(share)).alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, scratch: Scratch, text: str = "text", target_text: str = "text", ident: tuple[str, ...] = ("doc_id",), orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``ident``, _row, n_words, n_features and weight of each document."""
    ident = list(ident)
    table = scratch.table(positions(docs, text, ident, orders, buckets))
    goal = positions(target, target_text, [], orders, buckets)
    gain = scratch.table(gains(_runs(table), _runs(goal), scratch, buckets))
    per = _runs(table, "_row").join(F.broadcast(gain), "b").groupBy("_row").agg(F.sum("gain").alias("weight"))
    count = sum((F.col(f"b{k}").isNotNull().cast("long") for k in range(1, orders + 1)), F.lit(0))
    size = table.groupBy("_row", *ident).agg(F.count("b1").alias("n_words"), F.sum(count).alias("n_features"))
    return size.join(per, "_row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", id_column: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document; drawn are ``percent`` of those with ``least_words``, others have no rank."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    w = weighed(own, target.select(F.col(target_text).alias("text")), scratch, **options)
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), F.lit(""))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    w = scratch.table(w.withColumn("score", F.col("weight") + noise))
    able = w.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = able.select("_row", (-F.col("score")).alias("_least"), "doc_id")
    top = ranked(order, [], ["_least", "doc_id", "_row"], "rank", scratch.table).where(F.col("rank") <= drawn).select("_row", "rank")
    return w.join(top, "_row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Result of op13: doc_id, n_features, weight, score, rank."""
    return resampled(docs, benchmark).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")])


def gain_of(s: int, t: int, all_s: int, all_t: int, buckets: int = BUCKETS) -> int:
    """The gain of one bucket, as plain arithmetic."""
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
