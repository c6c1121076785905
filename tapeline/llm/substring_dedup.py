"""Substring dedup by difference-cover anchors.

Two equal passages of ``window`` words start anywhere in their documents. With a difference cover
D of the residues modulo ``PERIOD`` there is, for any two starts, a shift below PERIOD that brings
both to places whose residue is in D. So grams of ``window - PERIOD + 1`` words are hashed at those
places only (5 of 21), and any long match shares an aligned anchor. Windows around anchors that
occur twice are then extended to the full ``window`` words and compared by 95 bits of hash; what a repeated
window covers is removed, all its occurrences alike.

Whether a hash recurs is settled in the task that makes it where it can be: a place whose hash the task has met
elsewhere is a hit, dealt out by its text, and sends its hash on only once. So however often one passage
occurs, no task gets more of it than one place from each task, and the places that a task settled itself spread.

Work is done once for each distinct text; copies of a text of ``window`` words or more are covered
whole. Defined cases: a null text is an empty one, an empty table gives an empty result, equal rows
count as separate occurrences, very long texts are handled whole, each a chunk of its own; there are no ties, as
all places of a repeated window go; other columns of the input, of whatever names, are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dist import by_runs, hidden, repeated
from .words import chunks, grams, mix, words

WINDOW = 35
#: Texts, and repeated hashes, that a task remembers; beyond it they start anew, and a few places are sent twice.
REMEMBERED = 1 << 18
#: A perfect difference set: every residue modulo 21 is the difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def text_key(text: str) -> list[Column]:
    """A text's identity: two longs (64-bit hash; length with another hash)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("_k1"), (F.hash(t).cast("long") * F.lit(1 << 30) + F.length(t)).alias("_k2")]


def _parameters(window: int) -> tuple[int, tuple[int, ...]]:
    return (PERIOD, COVER) if window >= PERIOD + 5 else (1, (0,))


class Met:
    """Settles what a task can: which places have a hash that the task has met at another place."""

    #: hash: of the words, or for hits the text's key, which deals them out; tail: the sign for hits, 31 more bits of hash, 32 bits of place.
    schema = pa.schema([("hash", pa.int64()), ("tail", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64())])
    ddl = "hash long, tail long, _k1 long, _k2 long"

    def __init__(self):
        self.repeated = np.zeros((0, 2), np.uint64)

    def rows(self, h: np.ndarray, check: np.ndarray, k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        """Rows of distinct places: of a hash met elsewhere without it (hits), and each hash that is new to the task once with it."""
        both = np.stack([h, check], axis=1)
        order = np.lexsort((check, h)) if check.any() else np.argsort(h, kind="stable")
        both, k1, k2, pos = both[order], k1[order], k2[order], pos[order]
        new = np.append(True, (both[1:] != both[:-1]).any(axis=1))
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        known = np.zeros(len(size), dtype=bool)
        if len(self.repeated):
            first = both[new]
            at = np.minimum(np.searchsorted(self.repeated[:, 0], first[:, 0]), len(self.repeated) - 1)
            known = (self.repeated[at] == first).all(axis=1)
        hit = (known | (size > 1))[run]
        sent = new & ~known[run]
        fresh = both[new][(size > 1) & ~known]
        if len(self.repeated) + len(fresh) > REMEMBERED:
            self.repeated = np.zeros((0, 2), np.uint64)
        self.repeated = np.concatenate([self.repeated, fresh[:REMEMBERED]])
        self.repeated = self.repeated[np.lexsort((self.repeated[:, 1], self.repeated[:, 0]))]
        i, j = np.flatnonzero(hit), np.flatnonzero(sent)
        settled, at = np.append(np.ones(len(i), dtype=bool), np.zeros(len(j), dtype=bool)), np.append(i, j)
        tail = both[at, 1] << np.uint64(32) | pos[at].astype(np.uint64)
        tail[settled] = pos[at][settled].astype(np.uint64) | np.uint64(1 << 63)
        deal = np.where(settled, k1[at], both[at, 0].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, tail.view(np.int64), k1[at], k2[at])], schema=self.schema)


def _check(h: np.ndarray, n: int) -> np.ndarray:
    """31 bits of each n words from their hashes ``h``, apart from ``grams(h, n)``: made of the words anew."""
    return grams(mix(h ^ np.uint64(0xA24BAED4963EE407)), n) >> np.uint64(33)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once for a partition, so that copies aren't sent by the thousand."""
    seen = Seen()
    for batch in batches:
        yield batch.filter(pa.array(seen.fresh(batch.column("_k1").to_numpy(), batch.column("_k2").to_numpy())))


class Seen:
    """The text keys that a task has met."""

    def __init__(self):
        self.keys: set[tuple[int, int]] = set()

    def fresh(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Which rows hold a key for the first time."""
        if len(self.keys) > REMEMBERED:
            self.keys = set()
        out = np.zeros(len(k1), dtype=bool)
        for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
            if key not in self.keys:
                self.keys.add(key)
                out[i] = True
        return out


def _anchors(window: int):
    period, cover = _parameters(window)
    n = window - period + 1
    at_cover = np.zeros(period, dtype=bool)
    at_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, met = Seen(), Met()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            for row, data, at in chunks(batch.column("text")):
                h, _, _, before = words(data, at)
                g = grams(h, n)
                rows, count = len(at) - 1, np.diff(before)
                fresh = count >= window
                fresh[fresh] = seen.fresh(k1[row : row + rows][fresh], k2[row : row + rows][fresh])
                doc = np.repeat(np.arange(rows), count)
                pos = np.arange(len(h)) - before[doc]
                i = np.flatnonzero(at_cover[pos % period] & fresh[doc] & (pos + n <= count[doc]))
                if len(i):
                    yield met.rows(g[i], np.zeros(len(i), np.uint64), k1[row + doc[i]], k2[row + doc[i]], pos[i].astype(np.int32))

    return run


def _repeated_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits, and of the other rows those whose hash has two places at least."""

    def unsettled(hits: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = batch.column("tail").to_numpy()
            cols = [batch.column("hash"), pa.array(tail >> 32), pa.array((tail & 0xFFFFFFFF).astype(np.int32)), batch.column("_k1"), batch.column("_k2")]
            split = pa.RecordBatch.from_arrays(cols, ["hash", "check", "pos", "_k1", "_k2"])
            hits.append(split.filter(pa.array(tail < 0)).select(["_k1", "_k2", "pos"]))
            yield split.filter(pa.array(tail >= 0))

    hits: list[pa.RecordBatch] = []
    for (_, _, pos, k1, k2), _ in repeated(unsettled(hits), ["hash", "check", "pos", "_k1", "_k2"], keys=2):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, pos)], ["_k1", "_k2", "pos"])
        yield from hits
        hits.clear()
    yield from hits


def _extend(window: int):
    period, _ = _parameters(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, met = Seen(), Met()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            places = batch.column("places")
            for row, data, at in chunks(batch.column("text")):
                h, _, _, before = words(data, at)
                g = grams(h, window)
                fresh = seen.fresh(k1[row : row + len(at) - 1], k2[row : row + len(at) - 1])
                if not len(g):
                    continue
                part = places.slice(row, len(at) - 1)
                doc = np.repeat(np.arange(len(at) - 1), pa.compute.list_value_length(part).to_numpy())
                start = part.flatten().to_numpy().astype(np.int64) + before[doc]
                # windows that begin up to period - 1 words before an anchor, inside the anchor's document
                low = np.maximum(start - period + 1, before[doc])
                high = np.minimum(start, before[doc + 1] - window) + 1
                ok = (high > low) & fresh[doc]
                mark = np.zeros(len(h) + 2, dtype=np.int32)
                np.add.at(mark, low[ok], 1)
                np.add.at(mark, high[ok], -1)
                i = np.flatnonzero(np.cumsum(mark)[: len(g)] > 0)
                if len(i):
                    d = np.searchsorted(before, i, "right") - 1
                    yield met.rows(g[i], _check(h, window)[i], k1[row + d], k2[row + d], (i - before[d]).astype(np.int32))

    return run


def _keep(window: int):
    schema = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("span_starts", pa.list_(pa.int32())), ("span_ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts, places, copied = batch.column("text"), batch.column("places"), batch.column("copied")
            for i in range(len(texts)):
                found = (texts[i].as_py() or "").encode().split()
                n = len(found)
                if copied[i].as_py() and n >= window:
                    removed, starts, ends = n, [0], [n]
                elif places[i].is_valid:
                    mark = np.zeros(n + 1, dtype=np.int32)
                    p = np.unique(places[i].values.to_numpy())
                    mark[p] += 1
                    mark[p + window] -= 1
                    gone = np.cumsum(mark)[:n] > 0
                    removed = int(gone.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    starts, ends = edges[::2].tolist(), edges[1::2].tolist()
                    found = list(compress(found, ~gone))
                else:
                    removed, starts, ends = 0, [], []
                if removed == n:
                    found = []
                for x, v in zip(out, (n, removed, b" ".join(found).decode(), starts, ends), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    return run


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct text: its key (_k1, _k2), n_words, n_removed, kept_text, and the removed word spans (starts, ends)."""
    keyed = docs.select(*text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = keyed.mapInArrow(_anchors(window), Met.ddl)
    hits = by_runs(anchors, "hash", ["tail", "_k1", "_k2"], _repeated_places, "_k1 long, _k2 long, pos int")
    places = hits.groupBy("_k1", "_k2").agg(F.collect_list("pos").alias("places"))
    once = keyed.mapInArrow(_once, keyed.schema).repartition("_k1", "_k2")
    full = once.join(places, ["_k1", "_k2"]).mapInArrow(_extend(window), Met.ddl)
    hits = by_runs(full, "hash", ["tail", "_k1", "_k2"], _repeated_places, "_k1 long, _k2 long, pos int")
    starts = hits.groupBy("_k1", "_k2").agg(F.collect_list("pos").alias("places"))
    counted = keyed.groupBy("_k1", "_k2").agg((F.count("*") > 1).alias("copied"))
    all_texts = once.join(counted, ["_k1", "_k2"]).join(starts, ["_k1", "_k2"], "left")
    return all_texts.mapInArrow(_keep(window), "_k1 long, _k2 long, n_words long, n_removed long, kept_text string, span_starts array<int>, span_ends array<int>")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` replaced by what is left of it, words joined by one space."""
    spans = repeated_spans(docs, text, window).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.col("kept_text").alias("_kept"))
    inner, names = hidden(docs)
    both = inner.select("*", *text_key(names[text])).join(spans, ["_k1", "_k2"])
    return both.select(*[F.col("_kept" if c == text else n).alias(c) for c, n in names.items()])


def digest(docs: DataFrame) -> DataFrame:
    """Result of op8: doc_id, n_words, n_removed, kept_sha256."""
    spans = repeated_spans(docs).select("_k1", "_k2", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    spans = spans.groupBy("_k1", "_k2").agg(*[F.max(c).alias(c) for c in ("n_words", "n_removed", "kept_sha256")])
    return docs.select("doc_id", *text_key("text")).join(spans, ["_k1", "_k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
