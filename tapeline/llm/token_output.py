"""Packed token-id output: best-fit-decreasing with a segment tree over capacities.

Documents are tokenised whole, an end id follows each, and overlong ones are split without loss
into pieces of the row length and a rest. Pieces are placed by falling length, each in the open row
with the least room that still holds it; a segment tree over room 0..length finds that row in
O(log length). The output has one row for each packed row of the id matrix: ids padded to the row
length (little-endian, 2 bytes if the vocabulary allows, else 4), cumulative segment lengths, the
places where positions restart, and which part of which document each segment is.

A task packs its own rows in blocks of BLOCK_TOKENS. Rows that aren't full enough are handed on to the
next block, the emptiest first and a quarter of a block at most; the others are sealed as they are. So
nothing is shuffled, and a task holds less than two blocks of pieces whatever their sizes are.

Defined cases: null text is empty and gives the end id alone; equal rows, null ids and null texts are
packed like others; pieces of equal length go in the order of their rows; very long texts are split;
an empty table gives none; ids keep their type; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import encoder

LENGTH, BLOCK_TOKENS, END_ID, PAD_ID = 2048, 1 << 22, 1, 0
SCHEMA = "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{id}>, doc_starts array<int>"


class Capacities:
    """Segment tree over room 0..length: leaf r is set while a row with room r is open."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.full = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i and not self.full[i]:
            self.full[i] = 1
            i >>= 1

    def best(self, size: int) -> int:
        """The least room >= size of an open row, or -1."""
        i = self.leaves + size
        if not self.full[i]:
            while i > 1 and (i & 1 or not self.full[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.leaves:
                i = 2 * i if self.full[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, room: int) -> int:
        row = self.rows[room].pop()
        if not self.rows[room]:
            i = self.leaves + room
            self.full[i] = 0
            i >>= 1
            while i and not (self.full[2 * i] or self.full[2 * i + 1]):
                self.full[i] = 0
                i >>= 1
        return row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of item numbers; every size is 1..length."""
    tree, rows = Capacities(length), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        room = tree.best(size)
        if room < 0:
            row, room = len(rows), length
            rows.append([])
        else:
            row = tree.take(room)
        rows[row].append(item)
        if room > size:
            tree.put(room - size, row)
    return rows


def handed_on(filled: list[int], length: int, most: int) -> set[int]:
    """Of rows with so many ids, those that the next block fills up: not nearly full, the emptiest first, ``most`` ids in all."""
    order = [k for k in sorted(range(len(filled)), key=filled.__getitem__) if filled[k] < length - length // 64]
    total = np.cumsum([filled[k] for k in order])
    return set(order[: int(np.searchsorted(total, most, "right"))])


def split(ids: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of one document."""
    return [(b, ids[b : b + length]) for b in range(0, len(ids), length)]


def _pack(tokenizer: str, length: int, end_id: int, pad_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind = np.dtype("<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        number = TaskContext.get().partitionId() << 40
        pieces: list[tuple[object, int, np.ndarray]] = []
        held, id_type = 0, pa.int64()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, pieces, held
            rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), length)
            later = [] if last else handed_on([sum(len(pieces[i][2]) for i in row) for row in rows], length, block // 4)
            out: list[list] = [[] for _ in range(8)]
            for k, row in enumerate(rows):
                if k in later:
                    continue
                used = [pieces[i] for i in row]
                total = sum(len(p[2]) for p in used)
                cu = np.cumsum([0, *(len(p[2]) for p in used)])
                matrix = np.full(length, pad_id, kind)
                matrix[:total] = np.concatenate([p[2] for p in used])
                for x, v in zip(out, (number, total, len(used), matrix.tobytes(), cu.tolist(), cu[:-1].tolist(), [p[0] for p in used], [p[1] for p in used]), strict=True):
                    x.append(v)
                number += 1
                if len(out[0]) == 1024:
                    yield batch_of(out)
                    out = [[] for _ in range(8)]
            yield batch_of(out)
            pieces = [pieces[i] for k in sorted(later) for i in rows[k]]
            held = sum(len(p[2]) for p in pieces)

        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch_of(out: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            doc, id_type = batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type
            for row, ids, at in encode(batch.column("text"), end_id):
                for i in range(len(at) - 1):
                    pieces += [(doc[row + i], b, p) for b, p in split(ids[at[i] : at[i + 1]], length)]
                held += len(ids)
                if held >= block:
                    yield from flush(last=False)
        if pieces:
            yield from flush(last=True)

    return run


def packed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END_ID, pad_id: int = PAD_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """The packed rows of ``docs`` (SCHEMA, with the type of its ids)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, length, end_id, pad_id, block), SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet: the id matrix is the column ``ids``, row by row."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(packed: DataFrame, bytes_per_id: int = 2) -> DataFrame:
    """Back from packed rows to (doc_id, start, ids: array<int>) of each segment, for round trips."""
    id_type = packed.schema["doc_ids"].dataType.elementType
    schema = f"doc_id {id_type.simpleString()}, start int, ids array<int>"
    id_kind = to_arrow_type(id_type)
    kind = np.dtype(f"<u{bytes_per_id}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, ids = [], [], []
            for r in batch.to_pylist():
                matrix = np.frombuffer(r["ids"], kind)
                for k, (b, e) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
                    doc.append(r["doc_ids"][k])
                    start.append(r["doc_starts"][k])
                    ids.append(matrix[b:e].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(doc, id_kind), pa.array(start, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return packed.mapInArrow(run, schema)
