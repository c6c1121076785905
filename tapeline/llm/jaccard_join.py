"""Exact n-gram Jaccard self-join by a partition of the universe.

A document is its set of distinct word n-grams. Two sets with Jaccard >= t differ in at most
H = (1 - t) / (1 + t) * (|A| + |B|) elements. The universe is hashed into m segments, m fixed by a
band of sizes (with one more group of segments at each border between bands), so of the segments of
a set that hold something, only so many can differ:

* in large bands a segment subset is indexed as it is: with H + 1 or more non-empty segments, one is equal;
* in small bands the subsets and all their one-deletion neighbourhoods are indexed: with H // 2 + 1
  segments of two elements or more, one differs by one deletion at most.

m has some slack, and the cost-based allocation spends it: of its matched segments each set gives up
the most frequent ones, half of its slack at most, which keeps the pigeonhole valid from both sides.
Sets that have too few filled segments (chance only) are joined among themselves by prefix filtering,
which is exact too. Candidates are compared by their whole sets.

Only components are asked for, so groups of many copies are first joined through neighbours in an
order of each key, in a part of the index and then where sets of different components still share a
key; the full index then gives only pairs between different components, and of these only such whose parity sketches (a lower bound of their difference) allow a link. Copies (equal sets) are one node throughout.

Defined cases: null or empty text has an empty set and links with nothing; texts of fewer words than
n are one shingle; a null doc_id keeps a null component unless its group has another id; equal rows
are equal sets; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dist import Scratch, by_runs, components, hidden, joined, repeated
from .substring_dedup import text_key
from .tokens import give_up
from .words import NOT_SPACE, chunks, grams, mix, sequence_hash, words

#: First sizes of the bands; below 100 elements deletions are indexed.
BORDERS = (1, 6, 13, 25, 50, *(100 << k for k in range(40)))
DELETION_BELOW = 100
EXACT, DELETION, PREFIX = 0, 1, 2
DELETION_GROUPS = list(range(2 * BORDERS.index(DELETION_BELOW)))
#: Longs of the parity sketch, and its columns.
PARITY = 8
#: Sets that a task remembers as indexed.
SEEN = 1 << 18
BITS = [f"p{i}" for i in range(PARITY)]
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class Plan:
    """Segments of one group of sizes: number, needed, and whether deletions are indexed."""

    def __init__(self, code: int, total: int, threshold: int):
        # 100 * I >= t * U  <=>  |A symmetric difference B| <= (100 - t) * (|A| + |B|) / (100 + t)
        most = (100 - threshold) * total // (100 + threshold)
        self.code, self.deletion = code, code in DELETION_GROUPS
        self.needed = most // 2 + 1 if self.deletion else most + 1
        if self.deletion:
            self.m = self.needed + (max(1, self.needed // 3) if self.needed > 1 else 0)
        else:
            self.m = -(-self.needed * 6 // 5) + 2


def plans(n: int, threshold: int) -> list[Plan]:
    """The groups in which a set of n elements takes part."""
    k = max(i for i, b in enumerate(BORDERS) if b <= n)
    low, high = BORDERS[k], BORDERS[k + 1]
    out = [Plan(2 * k, 2 * (high - 1), threshold)]
    for j, border in ((k, low), (k + 1, high)):
        least, most = -(-threshold * border // 100), (border - 1) * 100 // threshold
        if least <= n <= most and border > 1 and (n < border or n * threshold <= 100 * (border - 1)):
            out.append(Plan(2 * j + 1, border - 1 + most, threshold))
    return out


def _sets(column: pa.Array, n: int, lower: bool, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, data, at in chunks(column):
        h, _, _, before = words(data, at, kind, lower)
        g = grams(h, n)
        for i in range(len(at) - 1):
            b, e = int(before[i]), int(before[i + 1])
            if e - b >= n:
                s = np.sort(g[b : e - n + 1])
                yield row + i, s[np.append(True, s[1:] != s[:-1])]
            elif e > b:
                yield row + i, np.array([sequence_hash(h[b:e])], np.uint64)
            else:
                yield row + i, np.zeros(0, np.uint64)


def _set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = mix(np.array([np.sum(mix(s + _A)) + np.uint64(len(s)) * _B], np.uint64))
    return int(x.view(np.int64)[0])


def _index_rows(s: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set with their tags: group (7 bits), kind (2), spare segments (11), segment (12)."""
    keys, tags = [], []
    value, place = mix(s + _B), (s >> np.uint64(32))
    for plan in plans(len(s), threshold):
        seg = ((place * np.uint64(plan.m)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(plan.m, np.uint64)
        np.add.at(sums, seg, value)
        count = np.bincount(seg, minlength=plan.m)
        filled = int((count >= (2 if plan.deletion else 1)).sum())
        base = np.array([plan.code], np.uint64) * _C
        spare = min(2047, max(0, (filled - plan.needed) // 2))
        head = plan.code << 25 | spare << 12
        used = np.flatnonzero(count)
        keys.append(mix(sums[used] + base + (used.astype(np.uint64) + np.uint64(1)) * _D))
        tags.append(head | EXACT << 23 | (used & 4095))
        if plan.deletion:
            i = np.flatnonzero(count[seg] > 1)
            keys.append(mix(sums[seg[i]] - value[i] + base + (seg[i].astype(np.uint64) + np.uint64(1)) * _D))
            tags.append(head | DELETION << 23 | (seg[i] & 4095))
        if filled < plan.needed:
            n = len(s)
            prefix = s[: n - -(-threshold * n // 100) + 1]
            keys.append(mix(prefix ^ (base + _A)))
            tags.append(np.full(len(prefix), plan.code << 25 | PREFIX << 23, np.int64))
    return np.concatenate(keys), np.concatenate(tags)


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY buckets whether the set has an odd number of elements there; two sets differ in as many elements at least as bits."""
    odd = np.bincount((mix(s + _C) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(n: int, lower: bool, kind: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            size, sid = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            parity = np.zeros((PARITY, batch.num_rows), np.int64)
            for i, s in _sets(batch.column("text"), n, lower, kind):
                size[i], sid[i], parity[:, i] = len(s), _set_id(s), _parity(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_k1"), batch.column("_k2"), pa.array(sid), pa.array(size), *map(pa.array, parity)], ["doc_id", "_k1", "_k2", "sid", "n", *BITS])

    return run


def _index(n: int, lower: bool, kind: np.ndarray, threshold: int):
    smallest = next(i for i in range(2, 1000) if 100 * (i - 1) >= threshold * i)  # below, only equal sets link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        seen: set[int] = set()
        keys, ids, tags, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            count = [len(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), count)), pa.array(np.concatenate(tags).astype(np.uint32).view(np.int32))], ["key", "sid", "tag"])

        for batch in batches:
            for _, s in _sets(batch.column("text"), n, lower, kind):
                if len(s) < smallest - 1 or (sid := _set_id(s)) in seen:
                    continue
                if len(seen) >= SEEN:  # a set that is met again is indexed again, and its equal rows count once
                    seen.clear()
                seen.add(sid)
                k, t = _index_rows(s, threshold)
                keys.append(k)
                tags.append(t)
                ids.append(sid)
                held += len(k)
                if held > 100_000:
                    yield flush()
                    keys, ids, tags, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, sid, tag), freq in repeated(batches, ["key", "sid", "tag"]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, sid, tag, freq.astype(np.int32))], ["key", "sid", "tag", "freq"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a run with the run's first and with the one before it, if their roots differ."""
    key, first, last = None, (0, 0), (0, 0)
    for batch in batches:
        k, s, r = (batch.column(c).to_numpy() for c in ("key", "sid", "root"))
        if not len(k):
            continue
        new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        centre, centre_root = (np.where(start >= 0, x[np.maximum(start, 0)], f) for x, f in ((s, first[0]), (r, first[1])))
        before, before_root = np.append(last[0], s[:-1]), np.append(last[1], r[:-1])
        key, first, last = k[-1], (centre[-1], centre_root[-1]), (s[-1], r[-1])
        a, b = np.concatenate([centre[~new], before[~new]]), np.concatenate([s[~new], s[~new]])
        apart = np.concatenate([centre_root[~new] != r[~new], before_root[~new] != r[~new]])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[apart], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _arrays(n: int, lower: bool, kind: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sid = batch.column("sid").to_pylist()
            ids, sets, held = [], [], 0
            for i, s in _sets(batch.column("text"), n, lower, kind):
                if sid[i] not in seen:
                    seen.add(sid[i])
                    ids.append(sid[i])
                    sets.append(s.tobytes())
                    held += len(sets[-1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "s"])
                        ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "s"])

    return run


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep[i] = 100 * both >= threshold * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: int = 80, lower: bool = True, kind: np.ndarray = NOT_SPACE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text key (_k1, _k2), n_shingles, component_id.

    component_id is the smallest doc_id that is reachable by links of Jaccard >= threshold / 100.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    info = scratch.table(texts.mapInArrow(_describe(n, lower, kind), f"doc_id {id_type}, _k1 long, _k2 long, sid long, n int, {', '.join(f'{p} long' for p in BITS)}"))
    index = texts.select("text").mapInArrow(_index(n, lower, kind, threshold), "key long, sid long, tag int")
    matched = scratch.table(by_runs(index, "key", ["sid", "tag"], _matched, "key long, sid long, tag int, freq int"))
    one = info.where("n > 0").groupBy("sid").agg(F.min(F.struct("_k1", "_k2")).alias("k"), *[F.first(c).alias(c) for c in ("n", *BITS)])
    one = one.select("sid", "n", *BITS, "k._k1", "k._k2")

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of set ids whose sets are similar."""
        pairs = scratch.table(pairs.distinct())
        ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        ids = scratch.table(ids.join(one, "sid").select("_k1", "_k2", "sid"))
        sets = joined(texts, ids, ids.count(), 24, ["_k1", "_k2"], "inner").select("sid", "text")
        sets = sets.mapInArrow(_arrays(n, lower, kind), "sid long, s binary").dropDuplicates(["sid"])
        both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
        found = scratch.table(both.mapInArrow(_compare(threshold), "a long, b long"))
        scratch.drop(ids, pairs)
        return found

    def near(rows: DataFrame) -> DataFrame:
        """Links found among neighbours in the runs of equal keys, each key in an order of its own."""
        rows = rows.select("key", "sid", "root", F.xxhash64("key", "sid").alias("turn"))
        return linked(by_runs(rows, "key", ["turn", "sid"], _first_pairs, "a long, b long"))

    def rooted(edges: DataFrame) -> DataFrame:
        """Set ids with size, parity sketch and root of their component."""
        roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
        nodes = one.select("sid", "n", *BITS).join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        return scratch.table(nodes.withColumn("root", F.coalesce("root", "sid")))

    def undecided(keys: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows (key, sid, kind) of keys that sets of different components share."""
        rows = keys.join(nodes, "sid")
        apart = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        return rows.join(apart, "key")

    sure = matched.where(F.col("tag").bitwiseAND(3 << 23) == EXACT).where(F.col("key").bitwiseAND(7) == 0)
    links = near(sure.select("key", "sid", F.col("sid").alias("root")))

    group, kind_of = F.shiftrightunsigned("tag", 25), F.shiftright("tag", 23).bitwiseAND(3)
    rows = matched.select("key", "sid", "freq", group.alias("grp"), kind_of.alias("kind"), F.shiftright("tag", 12).bitwiseAND(2047).alias("spare"), F.col("tag").bitwiseAND(4095).cast("long").alias("seg"))
    # a subset that is indexed without deletions is told by its key alone
    rows = rows.withColumn("seg", F.when(F.col("grp").isin(DELETION_GROUPS), F.col("seg")).otherwise(F.col("key")))
    # the most frequent segments of each set, as far as its slack goes, needn't be looked up
    rows = rows.where(F.col("kind") != PREFIX)
    cost = rows.groupBy("sid", "grp", "seg").agg(F.max("freq").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("sid", "grp").orderBy(F.desc("cost"), "seg"))
    spared = rows.join(cost.withColumn("rank", rank), ["sid", "grp", "seg"]).where("rank > spare").select("key", "sid", "kind")
    keys = spared.union(matched.where(kind_of == PREFIX).select("key", "sid", kind_of.alias("kind")))
    open_rows = scratch.table(undecided(keys, rooted(links)))
    links = links.union(near(open_rows.where(F.col("kind") == EXACT)))

    left = scratch.table(undecided(open_rows.select("key", "sid", "kind"), rooted(links)))
    right = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("sid", "kind", "n", "root", *BITS)])
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}2"))) for p in BITS[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("p02"))))
    may = (100 * F.least("n", "n2") >= threshold * F.greatest("n", "n2")) & (differ * (100 + threshold) <= (100 - threshold) * (F.col("n") + F.col("n2"))) & ((F.col("kind") != DELETION) | (F.col("kind2") != DELETION))
    late = linked(left.join(right, "key").where((F.col("root") != F.col("root2")) & (F.col("sid") < F.col("sid2")) & may).select(F.col("sid").alias("a"), F.col("sid2").alias("b")))

    roots = components(links.union(late).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    nodes = info.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
    nodes = nodes.select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "root").select("sid", "component")
    scratch.drop(matched, open_rows, left)
    full = info.join(nodes, "sid", "left")
    return full.select("doc_id", "_k1", "_k2", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the smallest doc_id (of equal rows, one). Empty documents stay."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    found = similar_groups(docs, **options)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "_k1", "_k2", "n_shingles").distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2"), "n_shingles")
    inner, names = hidden(docs)
    keyed = inner.select("*", *text_key(names[text]))
    same = F.col("_id").eqNullSafe(F.col(names[doc_id])) & (F.col("_a1") == F.col("_k1")) & (F.col("_a2") == F.col("_k2"))
    both = keyed.join(kept, same)
    # of rows equal in id and text one stays; empty texts stay as they are
    first = F.row_number().over(Window.partitionBy(names[doc_id], "_k1", "_k2").orderBy(*[F.col(n) for n in names.values() if inner.schema[n].dataType.typeName() != "map"]))
    one = both.withColumn("_row", first).where((F.col("_row") == 1) | (F.col("n_shingles") == 0))
    return one.select(*[F.col(n).alias(c) for c, n in names.items()])


def digest(docs: DataFrame) -> DataFrame:
    """Result of op5: 4-word shingles of lower-cased words, Jaccard >= 0.85."""
    return similar_groups(docs, n=4, threshold=85).select("doc_id", "n_shingles", "component_id")
