"""Alignment of two tokenizers' tokens by the bytes that they cover.

A is a byte-level tokenizer, which reads a space and the text; B a SentencePiece model, which adds that space itself. A text's
tokens end at byte offsets (cumsum of their lengths); offsets at which tokens of both end (intersect1d) cut both into groups, whose labels are found
by searchsorted. Tokens of A and B that share a label (of their end: the links; of their group: all pairs in it) are paired by
repeating each token of A by the number of its partners. How often two ids are linked is counted over all texts, in two
stages: by pair and salt, then by pair. Counts then go back to the links of each text.

Many texts are handled by one pass of NumPy: their tokens follow each other, so offsets are those of one long text. A
text's tokens are those of its chunks, which each worker encodes once (sentence_pieces.Chunks): neither tokenizer joins what
stands on the two sides of a chunk's end. Texts' links are kept as a table, one row for each text with its distinct
pairs; the counts are broadcast if they are few (checked by a count), else joined by a shuffle in which the pairs of
very many texts are dealt to several tasks.

Defined cases: null and empty texts have no tokens, and neither has a text whose tokens' bytes, A's or B's, differ from it (B reads
U+2581 as a space): zeros, and an empty digest. Special tokens' strings are plain text. Pairs of equal count are all
best. Rows of equal ids are different texts, and null ids stay; very long texts are handled alone; an empty table gives
no rows; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import array
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import Scratch, joined, small_enough
from .sentence_pieces import MODEL, SPACE, Chunks, Pieces
from .tokens import kept, tokenizer_path

BYTES = "byte_bpe_50k.json"
#: Salts of the first stage of counting; copies of the pairs of many texts in the join; bytes of text that one pass handles.
SALTS, COPIES, PASS_BYTES = 16, 16, 1 << 20
#: A pair of more texts than one in so many is dealt to several tasks.
HOT_SHARE = 1000
#: Chunks that are encoded together.
JOINED = 64
#: Bytes of a broadcast row: pair, count, mark.
ROW_BYTES = 24
TABLE = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


class ByteLevel:
    """A byte-level tokenizer: ids of chunks, and the bytes of each id."""

    def __init__(self, name: str = BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        # the byte-level alphabet: printable characters of Latin-1 stand for themselves, the rest follow from 256 on
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = {i: bytes(letters[c] for c in x) for x, i in vocabulary.items() if all(c in letters for c in x)}
        if self.tokenizer.normalizer is not None or {x for x in self.bytes.values() if len(x) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError(f"{name}: not a tokenizer of texts' own bytes")
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for i, x in self.bytes.items():
            self.size[i] = len(x)
        self.sizes = self.size.tolist()

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. Chunks are encoded together, as a space before a word parts it from the word before."""
        joined = [x for x in chunks if x[0] == " " and not x[-1].isspace()]
        found: dict[str, list[int]] = {}
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
            k = 0
            for x in part:
                start, left = k, len(x.encode())
                while left > 0:
                    left -= self.sizes[ids[k]]
                    k += 1
                found[x] = ids[start:k]
        alone = [x for x in chunks if x not in found]
        found.update((x, e.ids) for x, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        return [found[x] for x in chunks]


def common(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets at which tokens of both end, and the group of each token of A and of B."""
    single = all(len(e) < 2 or (e[1:] > e[:-1]).all() for e in (ends_a, ends_b))  # but for tokens without bytes
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=single)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def linked(label_a: np.ndarray, label_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens of equal label; labels are in order."""
    low, high = np.searchsorted(label_b, label_a, "left"), np.searchsorted(label_b, label_a, "right")
    n = high - low
    left = np.repeat(np.arange(len(label_a)), n)
    return left, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Digits:
    """Texts of many numbers, each followed by a byte, by one gather."""

    def __init__(self, most: int):
        texts = [str(k).encode() for k in range(most)]
        self.size = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each number's part ends."""
        size = self.size[ids]
        ends = np.cumsum(size + 1)
        start = ends - size - 1
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(start, size) + place] = self.pool[np.repeat(self.first[ids], size) + place]
        out[ends - 1] = after
        return out, ends


class Aligner:
    """Both tokenizers with the chunks that a worker knows."""

    def __init__(self, a: str = BYTES, b: str = MODEL):
        import sentencepiece

        self.a, self.b = ByteLevel(a), Pieces(b)
        self.library = sentencepiece.SentencePieceProcessor(model_file=b if os.path.sep in b else tokenizer_path(b))
        self.digits = Digits(max(len(self.a.size), len(self.b.size)))
        self.chunks = Chunks(self._encoded, self.b.cut)

    def _encoded(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B."""
        return [(array.array("i", a).tobytes(), array.array("i", b).tobytes()) for a, b in zip(self.a.ids(chunks), self.b_ids(chunks), strict=True)]

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of each chunk; it adds a space to a text, which stands for the one that a chunk begins with."""
        own = [x for x in chunks if len(x) > 1 and x[0] == " "]
        found = dict(zip(own, self.library.encode([x[1:] for x in own], num_threads=1), strict=True))
        return [found[x] if x in found else self.b.ids_of(x) for x in chunks]

    def tokens(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of A and B of each text; none where B reads another text (U+2581 as a space)."""
        ids_a, ids_b = [], []
        for found in self.chunks([(" " + x) if x and SPACE not in x else "" for x in texts]):
            a, b = zip(*found, strict=True) if found else ((), ())
            ids_a.append(b"".join(a))
            ids_b.append(b"".join(b))
        return ids_a, ids_b

    def aligned(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its links: ``pairs`` (a << 32 | b) with offsets ``at``."""
        ids_a, ids_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.frombuffer(b"".join(ids), np.int32) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        cuts, group_a, group_b = common(ends_a, ends_b)
        text_a, text_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        some = n_a > 0
        if (ends_a[text_a[1:][some] - 1] != ends_b[text_b[1:][some] - 1]).any():
            raise ValueError("the tokenizers cover a text by different numbers of bytes")
        # a text with tokens ends at a cut, so each text's groups follow each other
        group_at = np.append(0, np.where(text_a[1:] > 0, np.append(group_a, 0)[np.maximum(text_a[1:], 1) - 1] + 1, 0))
        group_at = np.maximum.accumulate(group_at)
        left, right = linked(ends_a, ends_b)
        at = np.searchsorted(left, text_a)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_at), "n_links": np.diff(at), "groups_sha256": self._digests(a, b, group_a, group_b, group_at),
            "pairs": a[left].astype(np.int64) << 32 | b[right], "at": at,
        }

    def _digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, group_at: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text: numbers in order of group and side, each with what follows it."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a, b])[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        after = np.where(last, np.where(side % 2, ord(";"), ord("|")), ord(",")).astype(np.uint8)
        out, ends = self.digits(ids, after)
        token = np.searchsorted(side, 2 * group_at)
        byte = np.append(0, ends)[token]
        raw = out.tobytes()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner, kept from task to task."""
    return kept(f"aligner:{a}:{b}", lambda: Aligner(a, b))


def links(docs: DataFrame, text: str = "text", id_column: str = "doc_id", a: str = BYTES, b: str = MODEL) -> DataFrame:
    """One row for each text: counts, digest, and its distinct linked pairs of ids (a, b) with how often it has them (times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= PASS_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                found = own.aligned(texts[start:end])
                pairs, at = found.pop("pairs"), found.pop("at")
                doc = np.repeat(np.arange(end - start), np.diff(at))
                order = np.lexsort([pairs, doc])
                pairs, doc = pairs[order], doc[order]
                new = np.append(True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(pairs))).astype(np.int32)
                offsets = pa.array(np.searchsorted(doc[first], np.arange(end - start + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((pairs[first] >> 32).astype(np.int32), (pairs[first] & 0xFFFFFFFF).astype(np.int32), times)]
                counts = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                columns = [pa.array(row + np.arange(end - start)), batch.column("doc_id").slice(start, end - start), *counts, pa.array(found["groups_sha256"], pa.string()), *lists]
                row += end - start
                start = end
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    df = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return df.mapInArrow(run, TABLE.format(id=df.schema["doc_id"].dataType.simpleString()))


def _pairs(table: DataFrame, *keep: str) -> DataFrame:
    return table.select(*keep, F.inline(F.arrays_zip("a", "b", "times")))


def counted(table: DataFrame) -> DataFrame:
    """(a, b, count, texts): links of each pair of ids over all texts, and texts that have it; by pair and salt first."""
    salted = _pairs(table).groupBy("a", "b", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.sum("times").alias("count"), F.count("*").alias("texts"))
    return salted.groupBy("a", "b").agg(F.sum("count").alias("count"), F.sum("texts").alias("texts"))


def aligned(docs: DataFrame, text: str = "text", id_column: str = "doc_id", a: str = BYTES, b: str = MODEL, broadcast: bool | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. ``broadcast`` decides how counts are joined; None: by their number."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.table(links(docs, text, id_column, a, b))
    counts = scratch.table(counted(table))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B
    marked = scratch.table(counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"), "texts"))
    rows = marked.count()
    if small_enough(rows, ROW_BYTES) if broadcast is None else broadcast:
        both = _pairs(table, "row").join(F.broadcast(marked), ["a", "b"])
    else:
        both = _dealt(_pairs(table, "row"), marked, table.count())
    per = both.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    out = table.drop("a", "b", "times").join(per, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _dealt(pairs: DataFrame, marked: DataFrame, texts: int) -> DataFrame:
    """The join by a shuffle: a pair of many texts has COPIES copies of its count, and its texts are dealt to them by row."""
    hot = F.col("texts") * HOT_SHARE > texts
    copies = marked.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))))
    # at most HOT_SHARE * (links of a mean text) pairs are that frequent, however many texts there are
    often = marked.where(hot).select("a", "b", F.lit(True).alias("often"))
    dealt = joined(pairs, often, often.count(), ROW_BYTES, ["a", "b"], "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.col("row"), F.lit(COPIES)).cast("int")).otherwise(0)).drop("often")
    return dealt.join(copies, ["a", "b", "salt"])


def digest(docs: DataFrame) -> DataFrame:
    """Result of op11."""
    return aligned(docs)
