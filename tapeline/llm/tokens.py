"""Token ids of whole texts, by a public tokenizer file, with a cache of words.

The tokenizer drops white space and never joins what stands on its two sides, so a text is cut at
spaces, tabs and line ends, each distinct piece of a chunk is encoded once, and ids are gathered by
NumPy. Pieces that hold other white space are encoded as they are.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import chunks, words

#: Distinct pieces kept by one task; beyond it the cache starts anew.
CACHE_PIECES = 1 << 20
#: Pieces that the tokenizer encodes at once.
TOGETHER = 1 << 12


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes Arrow text columns; ``name`` is a file of the public tokenizers or a path."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else tokenizer_path(name))
        self.cut = np.ones(256, dtype=bool)
        self.cut[[0x20, 0x09, 0x0A, 0x0D]] = False
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._reset()
        sizes, parts = [], []
        for k in range(0, len(pieces), TOGETHER):  # an encoded piece takes far more memory than its ids
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + TOGETHER], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        slot = len(self.size) + np.arange(len(keys))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.slot = np.concatenate([self.keys, keys])[order], np.concatenate([self.slot, slot])[order]

    def __call__(self, column: pa.Array, end_id: int | None = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, offsets of its rows); ``end_id`` follows each row's ids."""
        for row, data, at in chunks(column):
            h, first, end, before = words(data, at, self.cut)
            if len(h):
                uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                known = np.isin(uniq, self.keys, assume_unique=True)
                if len(self.keys) + int((~known).sum()) > CACHE_PIECES:
                    self._reset()
                    known[:] = False
                if not known.all():
                    raw = data.tobytes()
                    new = where[~known]
                    self._learn(uniq[~known], [raw[b:e].decode("utf-8", "replace") for b, e in zip(first[new].tolist(), end[new].tolist(), strict=True)])
                slot = self.slot[np.searchsorted(self.keys, uniq)][inverse]
                size = self.size[slot]
                total = np.append(0, np.cumsum(size))
                ids = self.pool[np.repeat(self.begin[slot] - total[:-1], size) + np.arange(total[-1])]
                ends = total[before]
            else:
                ids, ends = np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
            if end_id is not None:
                ids = np.insert(ids, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
            yield row, ids, ends


def kept(name: str, make):
    """What ``make`` gives, kept by this worker from task to task under ``name``; what other names hold is given up.

    Functions are sent by value, modules and all, so it hangs on a module that the worker itself imports.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_kept_encoders", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def give_up() -> None:
    """Frees what this worker keeps, for operators that need its memory and no tokenizer."""
    if module := sys.modules.get("tokenizers"):
        vars(module).pop("_kept_encoders", None)
    pa.default_memory_pool().release_unused()


def encoder(name: str = "word_bpe_49k.json") -> Encoder:
    """The worker's encoder of this name, with the pieces that it knows."""
    return kept(name, lambda: Encoder(name))
