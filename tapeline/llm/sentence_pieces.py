"""Encoding and decoding by a merge-type SentencePiece model: exact, by backtracking over longest matches.

The result is that of merging: the pair of neighbours whose joint piece has the best score is merged first, the leftmost of
equals, until no joint piece is left. A sequence of pieces is that result where each piece is what merging makes of its own
characters and all neighbours are compatible: re-merging the characters of the two gives the two again. So a text
is read from left to right. An Aho-Corasick automaton over the pieces names the longest piece at each place; where it
isn't compatible with the piece before, the next shorter one is tried; where none is, the piece before is given up, and its end
is marked in a field of bits, so that no place fails twice. Characters that are no piece become pieces of their bytes.

White space before a word may be joined to it, but no piece of the model goes on over white space after a word (other than
those kinds that the model's own pieces tell). There texts are cut into chunks. A worker encodes a chunk once and
keeps its ids under the chunk itself, so equal hashes can't mix chunks up.

Defined cases: null text is empty and has the ids of begin and end alone; U+2581 is read as a space, as the model does; very
long texts and chunks are read whole, each place once; equal rows and null ids are handled one by one; an empty table
gives no rows; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import array
import contextlib
import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import kept, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks, characters of one, and pairs of pieces that a worker keeps; beyond these the cache starts anew or passes a chunk by.
CACHE_CHUNKS, CACHE_CHARACTERS, CACHE_PAIRS = 1 << 19, 200, 1 << 20
#: Characters of texts whose new chunks are worked out together.
TOGETHER = 1 << 20
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
DIGEST = "doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Chunks:
    """Values of the chunks of texts, each worked out once by ``make`` (of a list of chunks)."""

    def __init__(self, make: Callable[[list[str]], list], cut: str = " "):
        ends = re.escape(cut)
        self.pattern = re.compile(rf"\s*+(?:\S++(?:[^\S{ends}]\s*+)?+)++|\s++")
        self.make, self.known = make, {}

    def __call__(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its chunks, in order; new chunks of several texts are worked out together."""
        at = 0
        while at < len(texts):
            start, size = at, 0
            while at < len(texts) and (at == start or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                at += 1
            parts = [self.pattern.findall(x) for x in texts[start:at]]
            values = [list(map(self.known.get, own)) for own in parts]
            new = {x for own, v in zip(parts, values, strict=True) if None in v for x, y in zip(own, v, strict=True) if y is None}
            found = self._found(new) if new else {}
            for own, v in zip(parts, values, strict=True):
                yield [found[x] if y is None else y for x, y in zip(own, v, strict=True)] if None in v else v

    def _found(self, new: set[str]) -> dict:
        """Values of chunks that aren't known, and become so but for long ones."""
        chunks = list(new)
        found = dict(zip(chunks, self.make(chunks), strict=True))
        if len(self.known) + len(found) > CACHE_CHUNKS:
            self.known.clear()
        self.known.update((k, v) for k, v in found.items() if len(k) <= CACHE_CHARACTERS)
        return found


class Pieces:
    """A merge-type model: ids of chunks by backtracking, and texts of ids."""

    def __init__(self, name: str = MODEL):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(tokenizer_path(name) if "/" not in name else name, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{name}: not a model of merges with bytes for unknown characters and texts as they are")
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        self.parts = parts = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        # a text may be cut before white space of a kind that no piece holds after other characters
        joined = {b for x in self.id for a, b in zip(x, x[1:], strict=False) if not (a.isspace() or a == SPACE) and (b.isspace() or b == SPACE)}
        if SPACE in joined:
            raise ValueError(f"{name}: pieces go on over spaces")
        self.cut = "".join(c for c in " \n" if c not in joined)

        self.pairs: dict[tuple[str, str], bool] = {}
        letters = {c for x in self.id for c in x}
        own = [x for x in self.id.keys() | letters if self.merged(x) == [x]]
        self.automaton = ahocorasick.Automaton()
        for x in own:
            self.automaton.add_word(x, len(x) - 1)
        self.automaton.make_automaton()
        pieces = set(own)
        #: Of each piece the next shorter one at its place, "" if there is none.
        self.shorter = {x: next((x[:k] for k in range(len(x) - 1, 0, -1) if x[:k] in pieces), "") for x in own}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text."""
        out = list(text)
        while len(out) > 1:
            scores = [self.score.get(a + b) for a, b in zip(out, out[1:], strict=False)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            k = scores.index(best)
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of two pieces gives the two again; the answer is kept."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of ``text``; characters that no piece holds stand alone."""
        longest = {end - more: more + 1 for end, more in self.automaton.iter(text)}  # of one place the longer ones end later
        out: list[str] = []
        at, n, failed = 0, len(text), 0
        pairs, shorter = self.pairs.get, self.shorter
        piece = last = ""  # ``piece`` is to be tried at ``at``: "" for the longest
        while at < n:
            if not piece:
                size = longest.get(at)
                if size is None:
                    last = text[at]
                    out.append(last)
                    at += 1
                    continue
                piece = text[at : at + size]
            while piece:
                if not failed or not failed >> (at + len(piece)) & 1:
                    if not last:
                        break
                    fits = pairs((last, piece))
                    if fits or (fits is None and self.compatible(last, piece)):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                last, piece = piece, ""
                continue
            while not piece:  # nothing fits here: what stands before is given up for its next shorter one
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                piece = shorter.get(piece, "")
            last = out[-1] if out else ""
        return out

    def ids_of(self, chunk: str) -> list[int]:
        parts = self.split(chunk.replace(" ", SPACE))
        ids = list(map(self.id.get, parts))
        if None not in ids:
            return ids
        out = []
        for x, i in zip(parts, ids, strict=True):
            out += [i] if i is not None else [self.byte[b] for b in x.encode("utf-8", "replace")]
        return out

    def packed(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each as little-endian unsigned 32-bit integers."""
        out = [array.array("I", self.ids_of(x)) for x in chunks]
        if sys.byteorder == "big":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    def surface(self, text: str) -> str:
        """What is cut into chunks: the text with the space that the model adds, U+2581 as a space."""
        return (self.prefix + text).replace(SPACE, " ") if text else ""

    def bytes_of(self, i: int) -> bytes:
        """The bytes that an id covers."""
        return self.parts[i]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: begin and end are nothing, one leading space of the first piece goes, wrong bytes become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        total = np.cumsum(size)
        if not len(ids) or not total[-1]:
            return ""
        out = self.pool[np.repeat(self.first[ids] - (total - size), size) + np.arange(total[-1])].tobytes()
        seen = int(np.flatnonzero(size)[0])
        head = 1 if self.prefix and self.spaced[ids[seen]] else 0
        if not (size[seen:] == 0)[: int(np.flatnonzero(size)[-1]) - seen].any():  # begin and end may stand within, and part bytes
            with contextlib.suppress(UnicodeDecodeError):
                return out[head:].decode()
        return self._mended(ids)

    def _mended(self, ids: np.ndarray) -> str:
        """``decode`` where runs of byte pieces aren't UTF-8: each byte that starts no character is U+FFFD."""
        out, run, started = [], bytearray(), False

        def flush() -> None:
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + k]).decode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        if k == 4 or at + k >= len(run):
                            out.append("�")
                            at += 1
                            break
            run.clear()

        for i in ids.tolist():
            part = self.pool[self.first[i] : self.first[i] + self.size[i]].tobytes()
            if self.is_byte[i]:
                run += part
                started = True
                continue
            flush()
            if part:
                out.append(part[1:].decode() if self.prefix and self.spaced[i] and not started else part.decode())
                started = True
        flush()
        return "".join(out)


def pieces(name: str = MODEL) -> tuple[Pieces, Chunks]:
    """The worker's model of this name and its chunks, kept from task to task."""

    def make() -> tuple[Pieces, Chunks]:
        model = Pieces(name)
        return model, Chunks(model.packed, model.cut)

    return kept(f"pieces:{name}", make)


def encoded(docs: DataFrame, text: str = "text", id_column: str = "doc_id", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, begin and end among them) and decoded, the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks = pieces(model)
        for doc, packed, words in _rows(batches, own, chunks):
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(words, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    df = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def _rows(batches: Iterator[pa.RecordBatch], own: Pieces, chunks: Chunks) -> Iterator[tuple[pa.Array, list[bytes], list[str]]]:
    begin, end = np.array([own.begin], "<u4").tobytes(), np.array([own.end], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [own.surface(x or "") for x in part.column("text").to_pylist()]
            packed = [b"".join([begin, *found, end]) for found in chunks(texts)]
            yield part.column("doc_id"), packed, [own.decode(np.frombuffer(x, "<u4")) for x in packed]


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Result of op12: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks = pieces(model)
        for doc, packed, words in _rows(batches, own, chunks):
            ids = [hashlib.sha256(x).hexdigest() for x in packed]
            texts = [hashlib.sha256(x.encode()).hexdigest() for x in words]
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, DIGEST.format(id=df.schema["doc_id"].dataType.simpleString()))
