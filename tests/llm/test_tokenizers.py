"""Alignment of two tokenizers and SentencePiece encoding, against the libraries and plain loops."""

import hashlib
import random
import struct
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeline.llm import sentence_pieces, token_alignment

SCHEMA = "doc_id long, text string, row long, a string, n_a string, salt int, score double"
PARTS = ["the", "ing", " ", "  ", "    ", "\n", "\t", "\r", ";\r\n", "▁", "é", "ß", "中文", "\U0001f600", "\x00", "　", "\xa0", "=", "==", "'s", "12", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", "hello", "World", "ت", "İ", "\x85", "\x1c", "zxqj"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return sentence_pieces.Pieces()


def made(seed=2):
    rng = random.Random(seed)
    mixed = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
    texts = [mixed(rng.randint(1, 40)) for _ in range(150)] + [" ".join(rng.choice(["word", "übung", "naïve", "zebra's", "x" * 30]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[160]] * 25 + [None, "", " ", "\n", "▁", "a▁b", "\U0001f600" * 50, "x" * 3000, "the " * 4000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    rows = [(i, t, 1, "x", "y", 2, 0.5) for i, t in enumerate(texts)]
    return [*rows, (5, texts[5], 1, "x", "y", 2, 0.5), (None, texts[6], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def ids_of(model, text):
    chunks = sentence_pieces.Chunks(lambda xs: [model.ids_of(x) for x in xs], model.cut)
    return [i for c in next(iter(chunks([model.surface(text)]))) for i in c]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=12))
def test_pieces_are_the_librarys(library, own, parts):
    text = "".join(parts)
    assert ids_of(own, text) == library.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(1, 260), st.sampled_from([1, 2, 28705, 259])), max_size=10))
def test_any_ids_decode_as_the_library_does(library, own, ids):
    if 0 not in ids:  # the unknown id never comes from bytes
        assert own.decode(ids) == library.decode(ids)


def test_runs_and_long_chunks(library, own):
    rng = random.Random(1)
    texts = [x * n for x in (" ", "a", "ab", "=", "\n", "é", "\U0001f600") for n in (1, 2, 3, 15, 16, 17, 33, 70)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(50_000)), "a" * 20_000]
    for x in texts:
        assert ids_of(own, x) == library.encode(x)


def test_places_that_fail_are_tried_once(own):
    """Backtracking: among words there are some for which the longest pieces first are wrong, and all are exact."""
    rng = random.Random(4)
    greedy = 0
    for _ in range(3000):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 12)))
        plain, found = own.merged(word), own.split(word)
        at, longest = 0, []
        while at < len(word):
            piece = next(word[at:k] for k in range(len(word), at, -1) if word[at:k] in own.shorter)
            longest.append(piece)
            at += len(piece)
        assert found == plain
        greedy += longest != plain
    assert greedy > 100


def test_chunks_beyond_the_cache_are_exact(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_CHUNKS", 20)
    monkeypatch.setattr(sentence_pieces, "CACHE_CHARACTERS", 8)
    monkeypatch.setattr(sentence_pieces, "CACHE_PAIRS", 50)
    model = sentence_pieces.Pieces()
    chunks = sentence_pieces.Chunks(lambda xs: [model.ids_of(x) for x in xs], model.cut)
    texts = [x or "" for _, x, *_ in made(9)]
    found = [[i for c in one for i in c] for one in chunks([model.surface(x) for x in texts])]
    assert found == library.encode(texts)
    assert len(chunks.known) <= 20 or max(map(len, chunks.known)) <= 8


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op12_equals_the_library(docs, rows, library):
    want = []
    for doc, text, *_ in rows:
        ids = [1, *library.encode(text or ""), 2]
        want.append((doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids).encode())))
    found = sentence_pieces.digest(docs)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_encoded_ids_and_texts(docs, rows):
    found = sentence_pieces.encoded(docs).collect()
    want = {i: (t or "").replace("▁", " ") for i, t, *_ in rows if i is not None}
    assert len(found) == len(rows)
    for r in found:
        assert len(r.ids) == 4 * r.n_tokens
        if r.doc_id is not None:
            assert r.decoded == want[r.doc_id]


def plain_alignment(rows, library):
    """Tokens by the libraries, offsets by loops, counts by a dictionary."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    byte = token_alignment.ByteLevel().bytes
    piece = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
    texts, count = [], Counter()
    for doc, text, *_ in rows:
        raw = (" " + text).encode() if text else b""
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text) if text else []
        if b"".join(map(piece, b)) != raw or b"".join(byte[i] for i in a) != raw:
            a, b = [], []
        ends = []
        for ids, size in ((a, lambda i: len(byte[i])), (b, lambda i: len(piece(i)))):
            at, own = 0, []
            for i in ids:
                at += size(i)
                own.append(at)
            ends.append(own)
        pairs = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f] if len(a) < 500 else [(a[ends[0].index(e)], y) for e, y in ((f, b[ends[1].index(f)]) for f in sorted(set(ends[0]) & set(ends[1])))]
        count.update(pairs)
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            part = [",".join(str(i) for i, e in zip(ids, own, strict=True) if start < e <= cut) for ids, own in ((a, ends[0]), (b, ends[1]))] if len(a) < 500 else None
            groups.append(part and "|".join(part))
            start = cut
        texts.append((doc, a, b, groups, pairs))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [(doc, len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), (sha(";".join(groups).encode()) if groups else "") if None not in groups else None) for doc, a, b, groups, pairs in texts]


@pytest.mark.parametrize("broadcast", (None, False))
def test_op11_equals_plain_loops(docs, rows, library, broadcast, monkeypatch):
    monkeypatch.setattr(token_alignment, "HOT_SHARE", 20)
    want = plain_alignment(rows, library)
    found = token_alignment.aligned(docs, broadcast=broadcast)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted(map(tuple, found.collect()), key=lambda r: str(r[:7]))
    want = sorted(want, key=lambda r: str(r[:7]))
    assert [r[:7] for r in found] == [r[:7] for r in want]
    checked = [(f[7], w[7]) for f, w in zip(found, want, strict=True) if w[7] is not None]
    assert len(checked) > 200 and all(f == w for f, w in checked)
    assert any(r[1] == 0 and r[0] is not None for r in found) and any(r[5] < r[4] for r in found)


def test_all_pairs_of_equal_labels():
    import numpy as np

    a, b = np.array([0, 0, 1, 3, 3, 3]), np.array([0, 1, 1, 2, 3])
    left, right = token_alignment.linked(a, b)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(i, j) for i in range(6) for j in range(5) if a[i] == b[j]]
    cuts, one, two = token_alignment.common(np.array([2, 5, 6, 9]), np.array([1, 5, 9]))
    assert cuts.tolist() == [5, 9] and one.tolist() == [0, 0, 1, 1] and two.tolist() == [0, 0, 1]


def test_tables_without_rows(spark, docs):
    none = docs.limit(0)
    assert token_alignment.digest(none).count() == 0 and sentence_pieces.digest(none).count() == 0
    assert token_alignment.digest(docs.where("text is null")).first().groups_sha256 == ""
