"""Benchmark decontamination by greedy string tiling.

A document and a test item are tiled: again and again the longest common run of words that no tile
has used yet, in either, becomes a tile, down to ``least`` words. Runs are found from shared seeds
(Karp-Rabin hashes of ``least`` words) that follow each other on one diagonal. What share of the item's
words the tiles cover doesn't depend on their order, so reordered passages are caught too; a document
is contaminated by an item from ``coverage`` on. An item of fewer than ``least`` words is one seed of
its own length: it is found where it stands whole.

Seeds of the items are a table. Tiles that cover enough of an item of n words hold ``coverage * n / least``
of its seed places at least, so an item is found by any but so many, less one, of its places, and
is looked up by those whose seeds are rarest among the items. Documents send only seeds that pass a bit map of these, of
2 ** MAP_BITS bits at most; a join by seed gives pairs of a document's text and an item. Each text
goes once to a task with PAIRS of its items at most, and is tiled with one after another. The driver
holds the bit map and nothing else of items or documents; a task one document and a batch of items.

Defined cases: null texts are empty; empty items say nothing; equal items and equal documents are reported
each, null ids too; ties between longest runs go by place in the item, then in the document; very
long texts are tiled whole; empty tables give no rows; ids keep their type, and no other column is read
or clashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dist import Scratch, hidden, joined, small_enough
from .substring_dedup import text_key
from .words import ALNUM, chunks, grams, mix, words

LEAST, COVERAGE = 5, 0.8
#: Words of the shortest item for which documents are removed.
LEAST_ITEM = 5
#: Bits of the map for each seed, and the base-2 logarithm of its bits at most.
SEED_BITS, MAP_BITS = 32, 27
#: Items that a task tiles with one document's text.
PAIRS = 4096
_SIZE = 0x9FB21C651E98DF25


def tiles(p: np.ndarray, q: np.ndarray, n: int, m: int, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, words) from seeds: item place p and document place q agree for ``least`` words."""
    order = np.lexsort((q, q - p))
    p, q = p[order], q[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (np.diff(q) != 1) | (np.diff(q - p) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p))) + least - 1
    heap = [(-int(s), int(p[i]), int(q[i])) for i, s in zip(first, size, strict=True)]
    heapq.heapify(heap)
    used_p, used_q, out = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool), []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = ~(used_p[a : a + size] | used_q[b : b + size])
        if free.all():
            used_p[a : a + size] = used_q[b : b + size] = True
            out.append((a, b, size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return out


def _seeds(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each place on; those of other sizes differ."""
    return mix(grams(h, size) + np.uint64(size * _SIZE % 2**64))


def _item_seeds(least: int):
    names = ["seed", "other", "_k1", "_k2", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            for row, data, at in chunks(batch.column("text")):
                h, _, _, before = words(data, at, ALNUM, lower=True)
                for i in range(len(at) - 1):
                    own = h[before[i] : before[i + 1]]
                    if len(own):
                        seed = _seeds(own, min(least, len(own)))
                        fixed = [np.full(len(seed), x) for x in (k1[row + i], k2[row + i])]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed.view(np.int64), mix(seed).view(np.int64), *fixed, np.arange(len(seed), dtype=np.int32), np.full(len(seed), len(own), np.int32))], names)

    return run


def _passing(bits: int, wordmap: np.ndarray, sizes: list[int]):
    """Seeds of documents whose two bits are set, once for each text of a chunk."""

    def bit(x: np.ndarray) -> np.ndarray:
        x = x >> np.uint64(64 - bits)
        return (wordmap[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            for row, data, at in chunks(batch.column("text")):
                h, _, _, before = words(data, at, ALNUM, lower=True)
                for size in sizes:
                    seed = _seeds(h, size)
                    hit = np.flatnonzero(bit(seed))
                    hit = hit[bit(mix(seed[hit]))]
                    doc = np.searchsorted(before, hit, "right") - 1
                    inside = hit + size <= before[doc + 1]
                    both = np.unique(np.stack([doc[inside], seed[hit[inside]].view(np.int64)], axis=1), axis=0)
                    if len(both):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 1])), pa.array(k1[row + both[:, 0]]), pa.array(k2[row + both[:, 0]])], ["seed", "_k1", "_k2"])

    return run


def _tile(least: int, coverage: float):
    """Of rows sorted by document, each document's text (kind 0) before its items (kind 1): the items that it holds."""
    names = ["_k1", "_k2", "i1", "i2", "coverage", "n_tiles", "longest_tile", "doc_starts", "doc_ends"]
    kinds = (*[pa.int64()] * 4, pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def hashes(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return words(data, np.array([0, len(data)]), ALNUM, lower=True)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, sorted_seeds = np.zeros(0, np.uint64), {}
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = [batch.column(c).to_pylist() for c in ("kind", "text", "_k1", "_k2", "i1", "i2")]
            for kind, text, k1, k2, i1, i2 in zip(*columns, strict=True):
                own = hashes(text)
                if kind == 0:
                    h, sorted_seeds = own, {}
                    continue
                size = min(least, len(own))
                if size not in sorted_seeds:
                    g = _seeds(h, size)
                    order = np.argsort(g, kind="stable")
                    sorted_seeds[size] = g[order], order
                g, order = sorted_seeds[size]
                seed = _seeds(own, size)
                low, high = np.searchsorted(g, seed, "left"), np.searchsorted(g, seed, "right")
                count = high - low
                # even all seeds together must cover enough
                cover = np.zeros(len(own) + 1, np.int32)
                at_item = np.flatnonzero(count)
                np.add.at(cover, at_item, 1)
                np.add.at(cover, at_item + size, -1)
                if not len(at_item) or (np.cumsum(cover)[:-1] > 0).sum() < coverage * len(own):
                    continue
                p = np.repeat(np.arange(len(seed)), count)
                q = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(p))]
                found = tiles(p, q, len(own), len(h), size)
                share = sum(t[2] for t in found) / len(own)
                if share >= coverage:
                    found.sort(key=lambda t: t[1])
                    for c, v in zip(out, (k1, k2, i1, i2, share, len(found), max(t[2] for t in found), [t[1] for t in found], [t[1] + t[2] for t in found]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def tiled(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """A row for each distinct text (_k1, _k2) of ``docs`` and distinct item text (i1, i2) that it holds, with coverage and tiles."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(*text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = benchmark.select(*text_key(item_text), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = scratch.table(items.where("text <> ''").dropDuplicates(["_k1", "_k2"]))
    seeds = items.mapInArrow(_item_seeds(least), "seed long, other long, _k1 long, _k2 long, place int, n int")
    # all but so many of an item's places as tiles that cover enough must share, less one
    spare = F.ceil(F.col("n") * F.lit(coverage) / F.least(F.lit(least), F.col("n"))) - 1
    rank = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("items", "seed", "place"))
    seeds = scratch.table(seeds)
    rare = seeds.join(seeds.groupBy("seed").agg(F.count("*").alias("items")), "seed").withColumn("rank", rank)
    rare = rare.where(F.col("rank") <= F.greatest(F.lit(1), F.col("n") - F.least(F.lit(least), F.col("n")) + 1 - spare))
    rare = scratch.table(rare.select("seed", "other", "_k1", "_k2", "n").distinct())

    sizes = sorted(r[0] for r in rare.select(F.least(F.lit(least), F.col("n"))).distinct().collect())  # 1..least at most
    bits = min(MAP_BITS, max(12, (SEED_BITS * rare.count()).bit_length()))
    mapped = rare.select(F.explode(F.array(*[F.shiftrightunsigned(c, 64 - bits) for c in ("seed", "other")])).alias("x")).groupBy(F.shiftright("x", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    wordmap = np.zeros(max(1, 1 << bits - 6), np.uint64)
    wordmap[mapped["at"].to_numpy()] = mapped["bits"].to_numpy().view(np.uint64)

    found = texts.mapInArrow(_passing(bits, wordmap, sizes), "seed long, _k1 long, _k2 long")
    pairs = found.join(rare.select("seed", F.col("_k1").alias("i1"), F.col("_k2").alias("i2")), "seed").select("_k1", "_k2", "i1", "i2").distinct()
    pairs = scratch.table(pairs)
    parts = scratch.table(pairs.groupBy("_k1", "_k2").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")))
    many = parts.count()

    no_item = [F.lit(None).cast("long").alias(c) for c in ("i1", "i2")]
    whole = joined(texts, parts, many, 20, ["_k1", "_k2"], "inner").dropDuplicates(["_k1", "_k2"])
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("_k1", "_k2", "part", F.lit(0).alias("kind"), *no_item, "text")
    asked = pairs.join(parts, ["_k1", "_k2"]).withColumn("part", F.pmod(F.xxhash64("i1", "i2"), F.col("parts")).cast("int"))
    asked = asked.join(items.select(F.col("_k1").alias("i1"), F.col("_k2").alias("i2"), "text"), ["i1", "i2"]).select("_k1", "_k2", "part", F.lit(1).alias("kind"), "i1", "i2", "text")
    rows = whole.union(asked).repartition("_k1", "_k2", "part").sortWithinPartitions("_k1", "_k2", "part", "kind", "i1", "i2")
    out = scratch.table(rows.mapInArrow(_tile(least, coverage), "_k1 long, _k2 long, i1 long, i2 long, coverage double, n_tiles int, longest_tile int, doc_starts array<int>, doc_ends array<int>"))
    scratch.drop(seeds, rare, pairs, parts, items)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, coverage, n_tiles, longest_tile, word spans."""
    found = tiled(docs, benchmark, text, item_text, least, coverage)
    ids = benchmark.select(F.col(item_id).alias("item_id"), *[c.alias(n) for c, n in zip(text_key(item_text), ("i1", "i2"), strict=True)])
    own = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text))
    both = joined(own, found, found.count(), 256, ["_k1", "_k2"], "inner").join(ids, ["i1", "i2"])
    return both.select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "doc_starts", "doc_ends")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", least: int = LEAST, least_item: int = LEAST_ITEM, **options) -> DataFrame:
    """``docs`` without the documents that hold an item of ``least_item`` words or more: shorter ones stand in clean text by chance, and are only reported."""
    long_items = benchmark.where(F.size(F.array_remove(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")) >= least_item)
    bad = tiled(docs, long_items, text, item_text, least, **options).select(F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2")).distinct()
    inner, names = hidden(docs)
    keyed = inner.select("*", *text_key(names[text]))
    n = bad.count()
    bad = F.broadcast(bad) if small_enough(n, 16) else bad
    left = keyed.join(bad, (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2")), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
