"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tapeline.llm import importance_resampling as resampling

SCHEMA = "doc_id long, text string, _row long, b1 string, rank long, weight string, _w string, gain string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def made():
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma1", "ÉCOLE", "straße", "Kelvin", "x", "7", "delta", "mu", "nu"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    texts = [prose(rng.randint(0, 80)) for _ in range(120)] + ["same words of a copied page " * 6] * 40
    texts += [None, "", " ;, ", "one", "two words", "three words here", prose(30_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (130, texts[130]), (None, texts[9]), (None, None)]
    target = ["alpha beta gamma1", "Alpha alpha alpha mu nu", None, "", "École straße x 7 " * 20]
    return rows, target


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(bucket(g) for _, x in rows for g in runs(x)[1]), Counter(bucket(g) for x in target for g in runs(x)[1])
    out = []
    for doc, text in rows:
        n, own = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in map(bucket, own))
        name = "" if doc is None else f"42:{doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    return out, [(r[0], r[4]) for r in drawn]


@pytest.fixture(scope="module")
def tables(spark):
    rows, target = made()
    docs = spark.createDataFrame([(*r, 1, "x", 9, "y", "z", "g") for r in rows], SCHEMA).repartition(5).cache()
    return rows, target, docs, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string").cache()


def test_op13_equals_plain_counting(tables):
    rows, target, docs, goal = tables
    want, drawn = plain(rows, target)
    found = resampling.digest(docs, goal)
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    got = found.collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(((r[0], *r[2:]) for r in want), key=str)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1)) and len(drawn) > 3


def test_targets_pull_their_documents(tables):
    """A document in the target's words weighs more than one of as many other words."""
    _, _, docs, goal = tables
    both = docs.sparkSession.createDataFrame([(1, "alpha beta gamma1 " * 10), (2, "unheard of things " * 10)], "doc_id long, text string")
    weight = {r.doc_id: r.weight for r in resampling.resampled(both, goal).collect()}
    assert weight[1] > weight[2]


def test_other_orders_and_buckets(tables):
    rows, target, docs, goal = tables
    found = resampling.resampled(docs, goal, orders=1, buckets=97, percent=50).collect()
    s, t = Counter(zlib.crc32(g.encode()) % 97 for _, x in rows for g in runs(x)[1][: runs(x)[0]]), Counter(zlib.crc32(g.encode()) % 97 for x in target for g in runs(x)[1][: runs(x)[0]])
    gain = {b: resampling.gain_of(s[b], t[b], s.total(), t.total(), 97) for b in s}
    want = sorted((str(doc), n, sum(gain[zlib.crc32(g.encode()) % 97] for g in own[:n])) for doc, (n, own) in ((doc, runs(x)) for doc, x in rows))
    assert sorted((str(r.doc_id), r.n_words, r.weight) for r in found) == want
    assert sum(r["rank"] is not None for r in found) == sum(r.n_words >= 20 for r in found) // 2


def test_empty_tables(tables):
    rows, _, docs, goal = tables
    assert resampling.digest(docs.limit(0), goal).count() == 0
    assert sorted((str(r.doc_id), r.weight) for r in resampling.digest(docs, goal.limit(0)).collect()) == sorted((str(r[0]), r[3]) for r in plain(rows, [])[0])
    assert all(r["rank"] is None and r.weight == 0 and r.n_features == 0 for r in resampling.digest(docs.where("text is null"), goal).collect())
