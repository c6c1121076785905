"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Bins are filled one after
another: of the examples that fit, the one whose demand has the largest dot product with what is
left (both relative to the limits) is placed, until none fits. Examples of equal demand are one type,
so a choice looks at types, not at examples; of equal products the type seen first is taken, and of
one type the earliest example.

``packed_examples`` packs whole instruction examples, whose parts bear a loss or don't, under all three
limits. ``packed_pieces`` packs documents, which may be cut: room that is left when none fits is filled by a
piece of the longest document, and the last rest of a task is cut at powers of two, where a sequence
needs no padding. All tokens of a document but a piece's first bear a loss, so there the token limit
binds before the loss limit, and a sequence may hold as many segments as tokens.

Each task packs its rows in blocks and hands on to its next block the one sequence that it could not
fill (documents), or sequences that are far from every limit, a quarter of a block at most (examples).

Defined cases: null text is empty (the end id alone); an example without parts, or with null parts, has
no tokens and a place in a sequence; a null loss mark is none; an example over a limit of its own has a
sequence of its own, uncut; equal rows and null ids are packed one by one; very long documents are cut;
an empty table gives no rows; ids keep their type; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

LENGTH, BLOCK_TOKENS, END_ID = 2048, 1 << 21, 1
#: Limits of a sequence of examples: tokens, segments, loss-bearing tokens.
LIMITS = (2048, 32, 1024)
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
EXAMPLES = "example_id {id}, n_tokens long, n_loss long, sequence_id long, offset long, ids binary, loss binary"


class Bins:
    """Chooses examples; ``limits`` are tokens, segments, loss-bearing tokens."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.float64)
        self.types: dict[tuple[int, int], int] = {}
        self.members: list[list[int]] = []
        self.demand = np.zeros((64, 3))
        self.count = np.zeros(64, np.int64)
        self.left = 0
        for i in range(len(tokens) - 1, -1, -1):
            self.put(i, int(tokens[i]), int(loss[i]))

    def put(self, item: int, tokens: int, loss: int) -> None:
        k = self.types.setdefault((tokens, loss), len(self.types))
        if k == len(self.members):
            self.members.append([])
            if k == len(self.count):
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.demand[k] = (tokens, 1, loss)
        self.members[k].append(item)
        self.count[k] += 1
        self.left += 1

    def choose(self, room: np.ndarray) -> int:
        """The example of the largest dot product among those that fit in ``room``, or -1."""
        n = len(self.members)
        demand = self.demand[:n]
        fits = (demand <= room).all(axis=1) & (self.count[:n] > 0)
        if not fits.any():
            return -1
        score = np.where(fits, demand @ (room / self.limits**2), -1.0)
        return self._take(int(np.argmax(score)))

    def longest(self) -> int:
        """The example with the most tokens, or -1."""
        n = len(self.members)
        return self._take(int(np.argmax(np.where(self.count[:n] > 0, self.demand[:n, 0], -1.0)))) if self.left else -1

    def _take(self, k: int) -> int:
        self.count[k] -= 1
        self.left -= 1
        return self.members[k].pop()


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> list[list[int]]:
    """Bins of whole examples (numbers); an example over a limit has a bin of its own."""
    own = (tokens > limits[0]) | (loss > limits[2])
    fit = np.flatnonzero(~own)
    bins, out = Bins(tokens[fit], loss[fit], limits), [[int(i)] for i in np.flatnonzero(own)]
    while bins.left:
        room, row = np.array(limits, np.float64), []
        while (i := bins.choose(room)) >= 0:
            row.append(int(fit[i]))
            room -= (tokens[fit[i]], 1, loss[fit[i]])
        out.append(row)
    return out


def _pieces(tokenizer: str, length: int, end_id: int, block: int):
    limits = (length, length, length)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def fill(items: list[list], last: bool) -> tuple[list[list[list]], list[list]]:
        """Sequences of [doc, start, ids, doc_tokens] and what is left over. A piece's first token bears no loss."""
        size = np.array([len(x[2]) for x in items], np.int64)
        bins, done = Bins(size, size - 1, limits), []
        while bins.left:
            room, row = np.array(limits, np.float64), []
            while room[0] > 0:
                i = bins.choose(room)
                if i < 0:
                    if (i := bins.longest()) < 0:
                        break
                    doc, start, ids, total = items[i]
                    k = int(room[0])
                    items.append([doc, start + k, ids[k:], total])
                    bins.put(len(items) - 1, len(ids) - k, len(ids) - k - 1)
                    items[i] = [doc, start, ids[:k], total]
                row.append(items[i])
                room -= (len(items[i][2]), 1, len(items[i][2]) - 1)
            if room[0] > 0 and not last and not bins.left:
                return done, row
            done.append(row)
        return done, []

    def at_powers(row: list[list]) -> Iterator[list[list]]:
        """A row cut into rows whose tokens are powers of two."""
        left = sum(len(x[2]) for x in row)
        queue = row[::-1]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                doc, start, ids, total = queue.pop()
                if len(ids) > want:
                    queue.append([doc, start + want, ids[want:], total])
                    ids = ids[:want]
                want -= len(ids)
                part.append([doc, start, ids, total])
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        items: list[list] = []
        held, id_type = 0, pa.int64()

        def emit(rows: list[list[list]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[list] = [[] for _ in names]
            for row in rows:
                offset = 0
                for doc, start, ids, total in row:
                    for x, v in zip(out, (doc, start, len(ids), zlib.crc32(ids), total, number, offset), strict=True):
                        x.append(v)
                    offset += len(ids)
                number += 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k else id_type) for k, x in enumerate(out)], names)

        for batch in batches:
            doc, id_type = batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type
            for row, ids, at in encode(batch.column("text"), end_id):
                ids = ids.astype("<u4")
                full = []
                for i in range(len(at) - 1):
                    own = ids[at[i] : at[i + 1]]
                    whole = len(own) - len(own) % length
                    full += [[[doc[row + i], b, own[b : b + length], len(own)]] for b in range(0, whole, length)]
                    if whole < len(own):
                        items.append([doc[row + i], whole, own[whole:], len(own)])
                        held += len(own) - whole
                yield from emit(full)
                if held >= block:
                    done, items = fill(items, last=False)
                    held = sum(len(x[2]) for x in items)
                    yield from emit(done)
        done, _ = fill(items, last=True)
        if done:
            if sum(len(x[2]) for x in done[-1]) < length:
                done[-1:] = list(at_powers(done[-1]))
            yield from emit(done)

    return run


def packed_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence (PIECES)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, length, end_id, block), PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _examples(tokenizer: str, limits: tuple[int, int, int], end_id: int, block: int):
    names = [c.split()[0] for c in EXAMPLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        items: list[tuple[object, np.ndarray, np.ndarray]] = []
        held, id_type = 0, pa.int64()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, items, held
            size = np.array([len(x[1]) for x in items], np.int64)
            loss = np.array([int(x[2].sum()) for x in items], np.int64)
            rows = pack(size, loss, limits)
            # how near a sequence is to the limit that it is nearest to
            near = [max(size[r].sum() / limits[0], len(r) / limits[1], loss[r].sum() / limits[2]) for r in rows]
            later: set[int] = set()
            left = 0 if last else block // 4
            for k in sorted(range(len(rows)), key=near.__getitem__):
                left -= int(size[rows[k]].sum()) + len(rows[k])
                if left < 0 or near[k] > 1 - 1 / 64:
                    break
                later.add(k)
            out: list[list] = [[] for _ in names]
            for k, row in enumerate(rows):
                if k in later:
                    continue
                offset = 0
                for i in row:
                    own, ids, mark = items[i]
                    for x, v in zip(out, (own, len(ids), int(loss[i]), number, offset, ids.tobytes(), mark.tobytes()), strict=True):
                        x.append(v)
                    offset += len(ids)
                number += 1
            items = [items[i] for k in sorted(later) for i in rows[k]]
            held = sum(len(x[1]) + 1 for x in items)
            kinds = (id_type, *[pa.int64()] * 4, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            own, id_type = batch.column("example_id").to_pylist(), batch.schema.field("example_id").type
            parts = batch.column("parts").fill_null([])
            texts, marks = (pa.compute.struct_field(parts.flatten(), k) for k in (0, 1))
            ids, at = [np.zeros(0, np.uint32)], [0]
            for _, some, ends in encode(texts, end_id):
                ids.append(some)
                at += [at[-1] + int(e) for e in ends[1:]]
            ids, mark = np.concatenate(ids).astype("<u4"), np.repeat(marks.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(at))
            first = np.append(0, np.cumsum(pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False)))
            for i, x in enumerate(own):
                b, e = at[first[i]], at[first[i + 1]]
                items.append((x, ids[b:e], mark[b:e]))
                held += e - b + 1
            if held >= block:
                yield from flush(last=False)
        if items:
            yield from flush(last=True)

    return run


def packed_examples(examples: DataFrame, example_id: str = "example_id", parts: str = "parts", tokenizer: str = "word_bpe_49k.json", limits: tuple[int, int, int] = LIMITS, end_id: int = END_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each example (EXAMPLES): its sequence and offset there, its ids and which of them bear a loss.

    ``parts`` is an array of (text, whether it bears a loss); an end id follows each part. ``limits`` are tokens, segments and loss-bearing tokens of a sequence.
    """
    rows = examples.select(F.col(example_id).alias("example_id"), F.col(parts).cast("array<struct<text:string,loss:boolean>>").alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    return rows.mapInArrow(_examples(tokenizer, limits, end_id, block), EXAMPLES.format(id=rows.schema["example_id"].dataType.simpleString()))


def conversations(turns: DataFrame) -> DataFrame:
    """Examples of (conv_id, turn, role, text): one for each conversation, its turns in order; those of the assistant bear a loss."""
    part = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    turned = turns.groupBy(F.col("conv_id").alias("example_id")).agg(F.array_sort(F.collect_list(part)).alias("turns"))
    return turned.select("example_id", F.transform("turns", lambda t: F.struct(t["text"].alias("text"), (t["role"] == "assistant").alias("loss"))).alias("parts"))
