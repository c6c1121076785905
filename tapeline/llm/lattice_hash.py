"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to eight dimensions, several times at random, and decoded to the nearest
point of the E8 lattice: a cell of a table. A vector is filed under its own cell and, as probes, under
those of the next lattice points (the best of the other coset of D8, and the next best of its own). Vectors that share a cell
are compared by cosine in double precision. A pair that shares several cells counts in the smallest.

Equal vectors of one label are one node with a size, so copies are never paired. Nodes are filed as
(cell, node) pairs; a vector itself is sent only to cells that it shares with another. A cell with more than
BLOCK nodes is split into blocks, and each pair of blocks is a task of its own. Links are counted, and
only a spanning forest of each task goes on to the components.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers, and vectors with a null
label, link with nothing and are their own component; vectors of different length never link; labels may be of any
simple type; equal rows are copies, and of several rows of one id each has its own links; the smallest id of a component
names it; an empty table gives no rows; no other column is read or clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import Scratch, by_runs, components
from .words import mix

THRESHOLD, TABLES, SCALE, SEED, BLOCK = 0.93, 8, 0.45, 7, 4096


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest points of D8 (integers of even sum) and the next best ones, with squared distances."""
    r = np.rint(x)
    gap = x - r
    step = np.where(gap >= 0, 1.0, -1.0)
    cost = 1 - 2 * np.abs(gap)  # of rounding a coordinate the other way
    order = np.argsort(cost, axis=1, kind="stable")
    rows = np.arange(len(x))
    odd = np.abs(r.sum(axis=1)) % 2 == 1
    near, other = r.copy(), r.copy()
    a, b = order[:, 0], order[:, 1]
    near[rows[odd], a[odd]] += step[rows[odd], a[odd]]
    other[rows, b] += step[rows, b]  # odd sums: one change, the second cheapest
    even = ~odd
    other[rows[even], a[even]] += step[rows[even], a[even]]  # even sums: two changes
    return near, ((x - near) ** 2).sum(axis=1), other, ((x - other) ** 2).sum(axis=1)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row and two neighbouring ones (n, 3, 8), in half units."""
    n0, d0, o0, e0 = _d8(x)
    n1, d1, o1, e1 = _d8(x - 0.5)
    n1, o1 = n1 + 0.5, o1 + 0.5
    swap = (d1 < d0)[:, None]
    best, second = np.where(swap, n1, n0), np.where(swap, n0, n1)
    third = np.where(swap, o1, o0)
    return np.rint(2 * np.stack([best, second, third], axis=1)).astype(np.int64)


def cells(unit: np.ndarray, tables: int, scale: float, seed: int = SEED) -> np.ndarray:
    """Cell numbers (n, 3 * tables) of unit vectors."""
    rng = np.random.default_rng(seed)
    weight = rng.integers(1, 2**63, (tables, 9), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for t in range(tables):
        plane = rng.standard_normal((unit.shape[1], 8)) / np.sqrt(8)
        shift = rng.random(8)
        point = decode(unit @ plane / scale + shift).astype(np.uint64)
        out.append(mix((point * weight[t, :8]).sum(axis=2) + weight[t, 8]))
    return np.concatenate(out, axis=1).view(np.int64)


def _salt(label: str, dim: int) -> np.uint64:
    return np.frombuffer(blake2b(f"{dim} {label}".encode(), digest_size=8).digest(), np.uint64)[0]


def _salted(unit: np.ndarray, label: str, tables: int, scale: float) -> np.ndarray:
    """Sorted cells of unit vectors of one label."""
    return np.sort((cells(unit, tables, scale).view(np.uint64) ^ _salt(label, unit.shape[1])).view(np.int64), axis=1)


def _file(tables: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            length = pa.compute.list_value_length(vectors).to_numpy()
            label = batch.column("label").dictionary_encode()
            code = label.indices.to_numpy()
            for dim in np.unique(length):
                for c in np.unique(code[length == dim]):
                    own = np.flatnonzero((length == dim) & (code == c))
                    v = vectors.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
                    v = v / np.abs(v).max(axis=1, keepdims=True)
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    at = _salted(unit, label.dictionary[int(c)].as_py(), tables, scale)
                    rest = [batch.column(x).take(pa.array(own)) for x in ("k", "size", "label")]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([np.unique(x) for x in at], pa.list_(pa.int64()))], ["k", "size", "label", "unit", "cells"])

    return run


def _links(threshold: float, tables: int, scale: float):
    def close(u: np.ndarray, half: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i < j) of unit vectors of cosine >= threshold; with ``cross`` only such of different halves."""
        found = [(np.zeros(0, np.int64),) * 2]
        for b in range(0, len(u), 1024):
            i, j = np.nonzero(u[b : b + 1024] @ u.T >= threshold - 1e-9)
            i += b
            ok = i < j
            if cross:
                ok &= half[i] != half[j]
            i, j = i[ok], j[ok]
            for p in range(0, len(i), 8192):
                x, y = i[p : p + 8192], j[p : p + 8192]
                sure = np.einsum("nd,nd->n", u[x], u[y]) >= threshold
                found.append((x[sure], y[sure]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def settled(nodes: list[tuple], pairs: list[tuple]) -> pa.RecordBatch:
        """Of pairs (cell, x, y; x, y are numbers of ``nodes``: k, size, unit, label) those whose smallest common cell it is: gains and roots of a spanning forest."""
        k, first, node = np.unique([n[0] for n in nodes], return_index=True, return_inverse=True)
        one = [nodes[i] for i in first]
        alike: dict[tuple[str, int], list[int]] = {}
        for i, n in enumerate(one):
            alike.setdefault((n[3], len(n[2])), []).append(i)
        at = np.zeros((len(one), 3 * tables), np.int64)
        for (label, _), own in alike.items():
            at[own] = _salted(np.stack([np.frombuffer(one[i][2], np.float64) for i in own]), label, tables, scale)
        size, gain, root = np.array([n[1] for n in one]), np.zeros(len(one), np.int64), np.arange(len(one))
        kept = []
        for cell, x, y in pairs:
            x, y = node[x], node[y]
            for p in range(0, len(x), 8192):
                i, j = x[p : p + 8192], y[p : p + 8192]
                common = at[i][:, :, None] == at[j][:, None, :]
                least = np.where(common.any(axis=2), at[i], np.iinfo(np.int64).max).min(axis=1)
                mine = least == cell[p : p + 8192]
                kept.append((i[mine], j[mine]))
        x, y = np.concatenate([f[0] for f in kept]), np.concatenate([f[1] for f in kept])
        np.add.at(gain, x, size[y])
        np.add.at(gain, y, size[x])
        while len(x):
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        tied = np.flatnonzero(gain)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (k[tied], gain[tied], k[root[tied]])], ["k", "gain", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        task = None
        nodes: list[tuple] = []
        pairs: list[tuple] = []

        def compare() -> None:
            """The pairs of one task, and the nodes that are in them, go to ``nodes`` and ``pairs``."""
            alike: dict[tuple[str, int], list[tuple]] = {}
            for row in part:
                alike.setdefault((row[6], len(row[5])), []).append(row)
            for rows in alike.values():
                if len(rows) < 2:
                    continue
                u = np.frombuffer(b"".join(r[5] for r in rows), np.float64).reshape(len(rows), -1)
                x, y = close(u, np.array([r[2] for r in rows]), rows[0][1])
                if len(x):
                    used, both = np.unique(np.concatenate([x, y]), return_inverse=True)
                    both = both + len(nodes)
                    nodes.extend((rows[i][3], rows[i][4], rows[i][5], rows[i][6]) for i in used)
                    pairs.append((np.full(len(x), rows[0][0]), both[: len(x)], both[len(x) :]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "cross", "half", "k", "size", "unit", "label")]
            tasks = batch.column("task").to_numpy()
            edges = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])).tolist() + [len(tasks)]
            rows = list(zip(*columns, strict=True))
            for b, e in zip(edges, edges[1:]):
                if task != tasks[b]:
                    if len(part) > 1:
                        compare()
                    task, part = tasks[b], []
                    if len(nodes) > BLOCK:
                        yield settled(nodes, pairs)
                        nodes, pairs = [], []
                part += rows[b:e]
        if len(part) > 1:
            compare()
        if nodes:
            yield settled(nodes, pairs)

    return run


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    scratch = Scratch(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0), F.lit(False))
    own = F.col(label) + 0.0 if vectors.schema[label].dataType.typeName() in ("float", "double") else F.col(label)  # 0.0 for -0.0
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, F.xxhash64(own, v)).alias("k"), own.cast("string").alias("label"), v.alias("v"))
    nodes = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    units = scratch.table(nodes.select("k", "size", "label", "v").mapInArrow(_file(tables, scale), "k long, size long, label string, unit binary, cells array<long>"))
    filed = units.select(F.explode("cells").alias("cell"), "k")
    shared = filed.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = filed.join(shared, "cell").withColumn("half", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", (F.col("half") != F.col("with")).alias("cross"), "half", F.xxhash64("cell", F.least("half", "with"), F.greatest("half", "with")).alias("task"), "k").join(units.drop("cells"), "k")
    # a block meets itself once and every other block once: rows of both are in that task
    found = scratch.table(by_runs(dealt, "task", ["cell"], _links(threshold, tables, scale), "k long, gain long, root long"))
    gains = found.groupBy("k").agg(F.sum("gain").alias("gain"))
    roots = components(found.select(F.col("k").alias("u"), F.col("root").alias("v")), scratch)
    held = nodes.select("k", "size", "least").join(gains, "k", "left").join(roots.select(F.col("node").alias("k"), "root"), "k", "left")
    held = held.select("k", (F.col("size") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "k").alias("root"))
    lowest = held.groupBy("root").agg(F.min("least").alias("component_id"))
    held = held.join(lowest, "root").select("k", "n_links", "component_id")
    out = rows.select("vec_id", "k").join(held, "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """Result of op7."""
    return similar_vectors(vectors)
