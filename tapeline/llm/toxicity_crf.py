"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from labelled documents: a word or stem that stands in toxic documents far more often
than chance tells (a z-test over document counts) is labelled 1 in those documents, every other
token 0. A two-state chain over the tokens of a sentence has hashed features (word, stems, suffix
and the two neighbours) and transition weights; it is fitted by AdaGrad on its exact gradient.
Forward-backward gives each token's marginal; a document's score is a logistic function of its
marginals (their sum, maximum and share), and runs of tokens over one half are its spans.

The model is fitted in one task on at most SAMPLE labelled documents, in the order of a hash of the id, and of
these on whole texts of SAMPLE_BYTES in all at most (a text that doesn't fit in any more is passed over). That
bounds the fit's memory, about 10 bytes for each byte of text. Every document is scored, whole, a run of
CHUNK_BYTES of text at a time.

Defined cases: null text is empty; labels and ids of labels that are null don't count; of several labels of one id
the largest holds; equal rows are scored alike, each for itself; a score of exactly the threshold is toxic; without
both labels every score is the share of toxic labels (0 if there are none); a very long text is a run of its own;
an empty table gives no rows; columns named score, text or like any helper pass through ``remove_toxic`` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import give_up
from .words import _BYTE, _LOWER, ALNUM, chunks, grams, mix, words

#: Labelled documents that the model is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 6000, 24 << 20
BITS, EPOCHS, RATE = 18, 3, 0.5
#: A word or a stem is listed from this z and these shares (of its documents, of the toxic ones) on.
Z, LEAST_RATE, LEAST_SHARE = 6.0, 0.3, 0.01
#: Stems are the first bytes of a word, so many of them; SUFFIX: last bytes.
STEMS, SUFFIX = (4, 5, 6, 7, 8), 3
_SALT = list(np.arange(1, 40, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 1))


def stems(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first bytes of each word, for each length in STEMS (0 if the word is shorter)."""
    out, total = [], np.zeros(len(first), np.uint64)
    for k in range(max(STEMS)):
        at = first + k
        total = total + np.where(at < end, _LOWER[data[np.minimum(at, len(data) - 1)]], np.uint64(0)) * _BYTE[k]
        if k + 1 in STEMS:
            out.append(np.where(first + k < end, mix(total + np.uint64(k)), np.uint64(0)))
    return out


def _suffix(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for k in range(SUFFIX):
        at = end - 1 - k
        out += np.where(at >= first, _LOWER[data[np.maximum(at, 0)]], np.uint64(0)) * _BYTE[k]
    return out


def features(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk: hashes of words and stems, feature numbers of each token, first of each sentence (and the end), firsts and ends in bytes, tokens before each row."""
    h, first, end, before = words(data, at, ALNUM, lower=True)
    n = len(h)
    breaks = np.zeros(256, dtype=bool)
    breaks[[ord(c) for c in ".!?\n"]] = True
    start = np.zeros(n + 1, dtype=bool)
    start[before] = True
    if n:
        stop = (end < len(data)) & breaks[data[np.minimum(end, len(data) - 1)]]
        start[1:] |= stop
    sentence = np.flatnonzero(start)
    if not len(sentence) or sentence[-1] != n:
        sentence = np.append(sentence, n)
    previous, following = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n > 1:
        previous[1:] = np.where(start[1:n], np.uint64(0), h[:-1])
        following[:-1] = np.where(start[1:n], np.uint64(0), h[1:])
    units = [h, *(stems(data, first, end) if n else [h] * len(STEMS))]
    f = [*units, _suffix(data, first, end) if n else h, previous, following]
    table = np.stack([(mix(x + s) >> np.uint64(64 - BITS)).astype(np.int32) for x, s in zip(f, _SALT)], axis=1) if n else np.zeros((0, len(f)), np.int32)
    return units, table, sentence, first, end, before


def marginals(score: np.ndarray, sentence: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and with ``pairs`` the sums of P(state, next state); ``score``: weight of state 1 over state 0."""
    n = len(score)
    size = np.diff(sentence)
    order = np.argsort(-size, kind="stable")
    head, size = sentence[:-1][order], size[order]
    trans = np.exp(move)
    emit = np.stack([np.ones(n), np.exp(np.clip(score, -30, 30))], axis=1)
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)] if n else [0]
    # active[t]: sentences longer than t
    active = [int((size > t).sum()) if t < 4 else int(np.searchsorted(-size, -t, "left")) for t in range(len(active))]
    at = head[: active[0]]
    now = emit[at] * np.exp(begin)
    now /= now.sum(axis=1, keepdims=True)
    alpha[at] = now
    for t in range(1, len(active)):
        k = active[t]
        if not k:
            break
        at = head[:k] + t
        now = (now[:k] @ trans) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    both = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        if not k:
            continue
        at = head[:k] + t
        x = emit[at] * beta[at]
        back = x @ trans.T
        if pairs:
            joint = alpha[at - 1][:, :, None] * trans[None] * x[:, None, :]
            both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post[:, 1] / np.maximum(post.sum(axis=1), 1e-300), both


def summary(p: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each row: 1, log of the expected number of toxic tokens, the largest marginal, their share."""
    n = np.diff(before)
    total = np.diff(np.append(0, np.cumsum(p))[before])
    most = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        most[full] = np.maximum.reduceat(p, before[full])
    return np.stack([np.ones(len(n)), np.log1p(np.maximum(total, 0)), most, total / np.maximum(n, 1)], axis=1)


class Model:
    """Weights of the chain and of the document score; as bytes they are about 1 MB, whatever they were fitted on."""

    def to_bytes(self) -> bytes:
        return pickle.dumps({k: v for k, v in vars(self).items()})

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        model = cls.__new__(cls)
        vars(model).update(pickle.loads(data))
        return model

    def __init__(self, texts: pa.Array, label: np.ndarray):
        self.weight = np.zeros(1 << BITS, np.float32)
        self.move, self.begin = np.zeros((2, 2)), np.zeros(2)
        self.final: np.ndarray | None = None
        self.share = float(label.mean()) if len(label) else 0.0
        if 0 < label.sum() < len(label):
            self._fit(texts, label)

    def _fit(self, texts: pa.Array, label: np.ndarray) -> None:
        # words and stems of toxic documents, by the number of documents; copies and near copies (one smallest trigram) count once
        units, counts, bads = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        families: set[int] = set()
        for row, data, at in chunks(texts):
            own, _, _, _, _, before = features(data, at)
            g = grams(own[0], 3)
            seen, toxic = [units], [bads]
            for i in range(len(before) - 1):
                trigrams = g[before[i] : max(before[i], before[i + 1] - 2)]
                family = int(trigrams.min()) if len(trigrams) else -1
                if family in families:
                    continue
                families.add(family)
                seen.append(np.unique(np.concatenate([u[before[i] : before[i + 1]] for u in own])))
                toxic.append(np.full(len(seen[-1]), label[row + i]))
            number = [counts, *(np.ones(len(x)) for x in seen[1:])]
            units, inverse = np.unique(np.concatenate(seen), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate(number), minlength=len(units))
            bads = np.bincount(inverse, weights=np.concatenate(toxic), minlength=len(units))
        z = (bads - counts * self.share) / np.sqrt(counts * self.share * (1 - self.share))
        listed = units[(z >= Z) & (bads >= LEAST_RATE * counts) & (bads >= max(5, LEAST_SHARE * label.sum())) & (units != 0)]
        del units, counts, bads, z
        parts = []
        for row, data, at in chunks(texts):
            own, table, sentence, _, _, before = features(data, at)
            doc = np.repeat(label[row : row + len(before) - 1], np.diff(before))
            found = np.logical_or.reduce([np.isin(u, listed) for u in own]) & (doc == 1)
            parts.append((table, sentence, before, found.astype(np.float32)))
        gains, moved, began = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
        for _ in range(EPOCHS):
            for table, sentence, _, gold in parts:
                if not len(gold):
                    continue
                score = self.weight[table].sum(axis=1)
                p, both = marginals(score, sentence, self.move, self.begin, pairs=True)
                slope = np.bincount(table.ravel(), weights=np.repeat(p - gold, table.shape[1]), minlength=1 << BITS)
                gains += slope**2
                self.weight -= (RATE * slope / np.sqrt(gains)).astype(np.float32)
                g = gold.astype(int)
                inner = np.ones(len(g), dtype=bool)
                inner[sentence[:-1]] = False
                own = np.zeros((2, 2))
                np.add.at(own, (g[:-1][inner[1:]], g[1:][inner[1:]]), 1)
                moved += (both - own) ** 2
                self.move -= RATE * (both - own) / np.sqrt(moved)
                first = sentence[:-1]
                lead = np.array([(1 - p[first]).sum() - (1 - gold[first]).sum(), p[first].sum() - gold[first].sum()])
                began += lead**2
                self.begin -= RATE * lead / np.sqrt(began)
        x = np.concatenate([summary(marginals(self.weight[t].sum(axis=1), s, self.move, self.begin)[0], b) if len(t) else summary(np.zeros(0), b) for t, s, b, _ in parts])
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(hess, x.T @ (p - label) + 1e-2 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.final = w


def _tag(model: Model):
    names = ["score", "span_starts", "span_ends"]
    kinds = [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            score, starts, ends = np.full(batch.num_rows, model.share), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            if model.final is not None:
                for row, data, at in chunks(batch.column("text")):
                    _, table, sentence, first, end, before = features(data, at)
                    p = marginals(model.weight[table].sum(axis=1), sentence, model.move, model.begin)[0] if len(table) else np.zeros(0)
                    score[row : row + len(at) - 1] = 1 / (1 + np.exp(-np.clip(summary(p, before) @ model.final, -30, 30)))
                    hot = np.flatnonzero(p > 0.5)
                    doc = np.searchsorted(before, hot, "right") - 1
                    for d in np.unique(doc).tolist():
                        own = hot[doc == d]
                        cut = np.flatnonzero(np.diff(own) != 1)
                        text = data[at[d] : at[d + 1]]
                        place = np.append(0, np.cumsum((text & 0xC0) != 0x80))  # characters before each byte
                        starts[row + d] = place[first[own[np.append(0, cut + 1)]] - at[d]].tolist()
                        ends[row + d] = place[end[own[np.append(cut, len(own) - 1)]] - at[d]].tolist()
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, k) for x, k in zip((score, starts, ends), kinds, strict=True))], [*(c for c in batch.schema.names if c != "text"), *names])

    return run


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of at most ``sample`` labelled documents, ``sample_bytes`` of text, that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(known), "_id")
    rows = rows.select("t", F.col("_label").cast("int").alias("y"), F.xxhash64("_id").alias("o")).orderBy("o", "t").limit(sample)
    # the sample's rows are in one partition, where the model is fitted
    found = rows.mapInArrow(_fit_here(sample_bytes), "model binary").first()
    return Model.from_bytes(found[0]) if found else Model(pa.array([], pa.string()), np.zeros(0))


def _fit_here(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, left = [], [], most
        for batch in batches:
            size = pa.compute.binary_length(batch.column("t")).to_numpy()
            keep = np.zeros(len(size), dtype=bool)
            for i, n in enumerate(size.tolist()):
                if n <= left:
                    keep[i], left = True, left - n
            texts.append(batch.column("t").filter(pa.array(keep)))
            labels.append(batch.column("y").to_numpy()[keep])
        if texts:
            model = Model(pa.chunked_array(texts).combine_chunks(), np.concatenate(labels).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    return run


def tagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **sample: int) -> DataFrame:
    """doc_id, _k (hash of the text), score, and character spans of toxic runs, for every row of ``docs``."""
    model = fit(docs, labels, doc_id, text, label, **sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _k long, score double, span_starts array<int>, span_ends array<int>"
    return rows.mapInArrow(_tag(model), schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the documents of a score of ``threshold`` or more."""
    text = options.get("text", "text")
    model = fit(docs, labels, **options)
    columns = docs.columns
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)], docs[text].alias("text"))
    rest = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    scored = inner.mapInArrow(_tag(model), f"{rest}, score double, span_starts array<int>, span_ends array<int>")
    return scored.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Result of op3: doc_id, held_out, score, predicted, and the spans."""
    found = tagged(docs, labels)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_starts", "span_ends")
