"""Each operator against a brute-force version or a round trip, on small tables with nulls, empty and long texts, ties and equal rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.llm import jaccard_join, lattice_hash, license_scan, line_templates, string_tiling, substring_dedup, token_output, toxicity_crf, url_rules, vector_packing
from tapeline.llm.dist import Scratch, components
from tapeline.llm.queries import oracle_sql as sql_of
from tapeline.llm.queries import queries as queries_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 long, sid string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def made(seed=5):
    """Rows (doc_id, text): prose, copies, near copies, shared passages, junk, nulls, one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "on", "th", "ér", "ü", "es", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))
    passage, base = prose(60), prose(150).split()
    rows = [prose(rng.randint(1, 300)) for _ in range(30)]
    rows += [rows[0]] * 5 + [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(4)]
    for k in range(12):
        w = base[:]
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocabulary) + "x"
        rows.append(" ".join(w))
    for n in (6, 7, 10, 14, 16, 30, 31):
        w = prose(n + 3).split()
        rows += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "zz"])]
    rows += ["", None, "   ", "one", "One", "two words", " ".join(["again"] * 200), prose(9000), "Kelvin \u212a and \u0130 CC BY \t all\x0brights reserved"]
    docs = [(i, t, None, "s", 1, 7, "x") for i, t in enumerate(rows)]
    return docs + [(3, rows[3], None, "s", 1, 7, "x"), (None, rows[1], None, "s", 1, 7, "x"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup(docs, rows, none):
    window = 35
    count = Counter(tuple(w[p : p + window]) for w in (space_words(r[1]) for r in rows) for p in range(len(w) - window + 1))
    wanted = Counter()
    for r in rows:
        w = space_words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        wanted[r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.digest(docs).collect()) == wanted
    assert substring_dedup.digest(none).count() == 0
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)


@pytest.mark.parametrize(("n", "threshold"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, none, n, threshold):
    sets = []
    for r in rows:
        w = space_words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    wanted = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        wanted[r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]] += 1
    found = jaccard_join.similar_groups(docs, n=n, threshold=threshold).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in found.collect()) == wanted
    if n == 5:
        kept = jaccard_join.keep_one(docs)
        empty = sum(not s for s in sets)
        assert kept.columns == docs.columns and kept.count() == empty + len({group[i] for i in range(len(rows)) if sets[i]})
        assert jaccard_join.similar_groups(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert {k: found.get(k, k) for k in root} == root


def encode():
    from tokenizers import Tokenizer

    from tapeline.llm.tokens import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_vector_packing(docs, rows, none):
    ids = encode()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in vector_packing.packed_pieces(docs, block=4000).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in s])
        assert [r.offset for r in s] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert ends[-1] == 2048 or not ends[-1] & (ends[-1] - 1)
    for r in rows:
        if r[0] is None or r[0] == 3:
            continue
        own, at = ids(r[1]), 0
        for p in sorted(pieces[r[0]], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(own)) and p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own)
    assert sum(p.length for ps in pieces.values() for p in ps) == sum(len(ids(r[1])) for r in rows)
    assert vector_packing.packed_pieces(none).count() == 0


def test_dot_product_respects_limits():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 120, 300)
    loss = np.minimum(tokens, rng.integers(0, 80, 300))
    bins = vector_packing.pack(tokens, loss, (100, 5, 60))
    assert sorted(i for b in bins for i in b) == list(range(300))
    for b in bins:
        assert len(b) == 1 or (tokens[b].sum() <= 100 and len(b) <= 5 and loss[b].sum() <= 60)


def test_token_output_round_trip(docs, rows, none):
    ids = encode()
    packed = token_output.packed_rows(docs, block=4000).cache()
    parts = defaultdict(list)
    for r in token_output.read_documents(packed).collect():
        parts[r.doc_id].append((r.start, r.ids))
    for r in rows:
        if r[0] is not None and r[0] != 3:
            assert [x for _, p in sorted(parts[r[0]]) for x in p] == ids(r[1])
    for r in packed.collect():
        assert len(r.ids) == 2 * token_output.LENGTH and r.cu_seqlens[-1] == r.n_tokens <= token_output.LENGTH and r.position_resets == r.cu_seqlens[:-1]
    assert token_output.packed_rows(none).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 65, 200)
    rows = token_output.best_fit_decreasing(sizes, 64)
    rooms, plain = [], []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [k for k, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= sizes[i]
            plain[k].append(i)
        else:
            rooms.append(64 - sizes[i])
            plain.append([i])
    assert sorted(sizes[r].sum() for r in rows) == sorted(sizes[r].sum() for r in plain)


def test_license_scan(docs, rows, none):
    wanted = Counter()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))
        hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        wanted[r[0], len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    found = license_scan.digest(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == wanted
    assert license_scan.digest(none).count() == 0


def test_license_templates(spark):
    texts = {"mit": "x\nReleased under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by,cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "gpl,gpl-3.0": "is licensed under the GNU General Public License, version 3.", "": "the license of a mit"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())] + [(9, "plain words")] * 20, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.digest(df).collect()}
    assert [found[i].labels for i in range(len(texts))] == list(texts)
    assert all(0 <= r.score <= 1 for r in found.values())


def plain_licences(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    out = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in f" {' '.join(w)} "}
    for label, statement, phrases in license_scan.TEMPLATES:
        s = statement.split()
        for o in range(-len(s), len(w)):
            at = lambda i: w[i] if 0 <= i < len(w) else None  # noqa: B023, E731
            keys = [(next(i for i in range(len(s)) if s[i : i + len(k.split())] == k.split()), k.split()) for k in phrases]
            if all(at(o + i + j) == x for i, k in keys for j, x in enumerate(k)) and sum(at(o + i) == x for i, x in enumerate(s)) >= 0.6 * len(s):
                out.add(label)
    return ",".join(sorted(out))


def test_license_scan_has_no_cap_of_words(spark):
    rng = random.Random(4)
    statements = [s for _, s, _ in license_scan.TEMPLATES]
    bsd = next(s for label, s, _ in license_scan.TEMPLATES if label == "bsd")
    texts = [" filler words ".join([bsd, "licensed under the apache license version 2 0", "released under the mit license"]), " and then ".join(statements), " x ".join(reversed(statements))]
    texts += [" so ".join(rng.sample(statements, rng.randint(2, 6))).replace(" of ", rng.choice([" of ", " from "])) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts + ["plain words"] * 800)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license_scan.digest(df).collect()}
    assert {"apache-2.0", "bsd", "mit"} <= set(found[0].split(","))
    assert [found[i] for i in range(len(texts))] == [plain_licences(x) for x in texts]


def test_license_scan_finds_common_statements(spark):
    texts = {0: "Licensed under the Apache License, Version 2.0", 1: "Released under the MIT License", 2: "Licensed under CC BY 4.0 and released under the MIT license"}
    df = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)] + [(i, "plain words") for i in range(60, 90)], "doc_id long, text string")
    assert all(r.labels == (plain_licences(texts[r.doc_id % 3]) if r.doc_id < 60 else "") for r in license_scan.digest(df).collect())
    bare = (("own", "alpha beta gamma delta epsilon", ()),)
    df = spark.createDataFrame([(0, "alpha beta gamma x y"), (1, "x y gamma delta epsilon"), (2, "alpha x y z epsilon")] * 5, "doc_id long, text string")
    assert {(r.doc_id, r.labels) for r in license_scan.scanned(df, templates=(*license_scan.TEMPLATES, *bare)).collect()} == {(0, "own"), (1, "own"), (2, "")}


def test_string_tiling(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    text = lambda *parts: " ".join([word() for _ in range(20)] + [x for p in parts for x in [*p, word()]])
    rows = [(0, text(item)), (1, text(item[20:], item[:20])), (2, text(item[:20])), (3, text(item[30:], item[10:20], item[20:30], item[:10])), (4, None), (5, ""), (0, text(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item).upper()), (8, "too short"), (9, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_tiles for r in string_tiling.contaminated(docs, items).collect()}
    assert set(found) == {(0, 7), (1, 7), (3, 7)} and found[1, 7] == 2
    assert {r.doc_id for r in string_tiling.remove_contaminated(docs, items).collect()} == {2, 4, 5}
    assert string_tiling.contaminated(none, items).count() == 0 and string_tiling.contaminated(docs, items.where("false")).count() == 0


def test_tiles_match_the_plain_algorithm():
    rng = random.Random(4)
    for _ in range(30):
        a, b = [rng.randrange(4) for _ in range(30)], [rng.randrange(4) for _ in range(60)]
        p, q = zip(*[(i, j) for i in range(28) for j in range(58) if a[i : i + 3] == b[j : j + 3]], strict=True)
        found = string_tiling.tiles(np.array(p), np.array(q), len(a), len(b), 3)
        used_a, used_b, sizes = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                        k += 1
                    best = max(best, (k, -i, -j))
            if best[0] < 3:
                break
            sizes.append(best[0])
            used_a |= set(range(-best[1], -best[1] + best[0]))
            used_b |= set(range(-best[2], -best[2] + best[0]))
        assert sizes[0] == max(t[2] for t in found)
        for i, j, n in found:
            assert a[i : i + n] == b[j : j + n]
        assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for _, _, n in found) == len({x for _, j, n in found for x in range(j, j + n)})


def test_toxicity(spark, docs, rows, none):
    rng = random.Random(6)
    plain = ["".join(rng.choice(["la", "mi", "ro", "ten"]) for _ in range(3)) for _ in range(200)]
    texts, marks = [], []
    for _ in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "rotter", "villain"]))
        texts.append(" ".join(w).capitalize() + ".")
        marks.append(int(bad))
    known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(marks), (None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity_crf.digest(known, labels).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in found:
        assert all(texts[r.doc_id][b:e].lower() in ("scoundrel", "rotter", "villain") or " " in texts[r.doc_id][b:e] for b, e in zip(r.span_starts, r.span_ends, strict=True))
    assert {r.doc_id for r in toxicity_crf.remove_toxic(known, labels).select("doc_id").collect()} == {r.doc_id for r in found if not r.predicted}
    mixed = toxicity_crf.digest(docs, labels)
    assert mixed.count() == len(rows) and mixed.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity_crf.digest(docs, labels.where("false")).where("score <> 0").count() == 0
    assert toxicity_crf.digest(none, labels).count() == 0 and toxicity_crf.remove_toxic(docs, labels).columns == docs.columns


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    score, move, begin = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    sentence = np.array([0, 4, 5, 7])
    p, _ = toxicity_crf.marginals(score, sentence, move, begin)
    for b, e in zip(sentence, sentence[1:]):
        total, ones = 0.0, np.zeros(e - b)
        for code in range(2 ** (e - b)):
            y = [code >> k & 1 for k in range(e - b)]
            x = np.exp(begin[y[0]] + sum(score[b + k] * y[k] for k in range(e - b)) + sum(move[y[k], y[k + 1]] for k in range(e - b - 1)))
            total += x
            ones += x * np.array(y)
        assert np.allclose(p[b:e], ones / total)


def test_line_templates(spark, docs, rows, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    own = [[line(rng.randint(9, 14)) for _ in range(4)] for _ in range(12)]
    for k, x in enumerate(own):
        x.insert(k % 4, "Sign up for the weekly letter today")
        x.insert(0, f"Page {k + 10} of the big web site archive")
    copies = [[line(12) for _ in range(5)]] * 9
    texts = ["\n".join(x) for x in own + copies]
    near = [line(11) for _ in range(6)]
    for k in range(8):
        texts.append("\n".join([*near[:3], near[3] + f" {word()}", *near[4:]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r for r in line_templates.drop_templates(df).collect()}
    for k in range(12):
        assert left[k].n_dropped == 2 and "weekly" not in left[k].text and "archive" not in left[k].text and left[k].text.count("\n") == 3
    for k in range(12, len(texts)):
        assert left[k].n_dropped == 0 and left[k].text == texts[k]
    found = line_templates.drop_templates(docs)
    assert found.count() == len(rows) and found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_templates.digest(none).count() == 0


def dropped(spark, texts):
    """The lines that each text loses."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r for r in line_templates.drop_templates(df).collect()}
    out = [sorted((Counter(t.split("\n")) - Counter(left[i].text.split("\n") if left[i].n_dropped < left[i].n_lines else [])).elements()) for i, t in enumerate(texts)]
    assert [len(x) for x in out] == [left[i].n_dropped for i in range(len(texts))]
    return out


def prose(rng):
    return lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_line_templates_count_each_family_once(spark):
    line = prose(random.Random(11))
    weekly, passage, notice, pair = "Sign up for the weekly letter today", line(60), line(30), [line(25), line(24)]
    near = [line(14) for _ in range(5)]
    texts = ["\n".join([*near, near[0] + f" {line(1)}", weekly]) for _ in range(30)]  # one family of copies
    texts += ["\n".join([line(12), line(9), weekly]) for _ in range(9)]
    texts += ["\n".join([line(12), passage, line(9)]) for _ in range(8)]
    texts += ["\n".join([notice, line(5)]) for _ in range(8)]
    texts += ["\n".join([*pair, line(6), line(5)]) for _ in range(8)]
    texts += [f"Report of the day {line(20)}\nAll prices are without any tax" for _ in range(8)]
    wanted = [[weekly]] * 39 + [[passage]] * 8 + [[notice]] * 8 + [sorted(pair)] * 8 + [["All prices are without any tax"]] * 8
    assert dropped(spark, texts) == wanted


@pytest.mark.parametrize("own", (1, 2, 5, 20, 40))
def test_longer_notices_never_mean_fewer_drops(spark, own):
    """A notice of 1 to 6 lines above two lines of their own: all its lines go, whatever is longer; copies of such pages count once."""
    line, texts, wanted = prose(random.Random(own)), [], []
    for k in range(1, 7):
        notice = [line(10) for _ in range(k)]
        pages = ["\n".join([*notice, line(own), line(own)]) for _ in range(20)]
        texts += pages
        wanted += [sorted(notice)] * 20
    texts += ["\n".join([line(8) for _ in range(4)])] * 30
    wanted += [[]] * 30
    assert dropped(spark, texts) == wanted


def test_near_copies_keep_their_lines(spark):
    """Copies of which each has some words changed, in first, middle or last places, are one family."""
    rng = random.Random(5)
    line = prose(rng)
    base, texts = [line(n) for n in (7, 22, 19, 9, 31, 12)], []
    for _ in range(40):
        lines = [x.split(" ") for x in base]
        for _ in range(2):
            one = rng.choice(lines)
            one[rng.choice([0, 1, len(one) // 2, -1])] = line(1)
        texts.append("\n".join(map(" ".join, lines)))
    assert dropped(spark, texts) == [[]] * 40


def test_line_templates_cut_tokens_at_white_space(spark):
    line = prose(random.Random(12))
    menu, long_token, script = "Home\tAbout\tContact\tHelp", "Home|About|Contact|Help|Imprint", "版权所有，未经许可不得转载"
    uneven = [f"{' ' * k}All rights  of this{' ' * (k + 1)}site are\t{' ' * k}reserved\r" for k in range(8)]
    texts = ["\n".join([line(12), menu, line(9), x, long_token, script, "short"]) for x in uneven]
    wanted = [sorted([menu, x, long_token, script]) for x in uneven]
    near = [f"    {line(13)}" for _ in range(6)]
    texts += ["\n".join(f"    {line(14)}" for _ in range(3)) + "\n    See the rules of this board" for _ in range(8)] + ["\n".join([*near, line(1)]) for _ in range(8)]
    wanted += [["    See the rules of this board"]] * 8 + [[]] * 8
    assert dropped(spark, texts) == wanted


def test_line_templates_drop_lines_of_variable_fields(spark):
    rng = random.Random(13)
    line = prose(rng)
    stamps = [f"Posted {k + 10} Mar 2024 at 1{k}:31" for k in range(8)]
    pages = [f"Page {k} of {k + 10}" for k in range(8)]
    fixed = ["12.50 13.50 14.50 15.50", "Page 3 of 10", "2024-03-12 10:31 99"]
    texts = ["\n".join([line(12), s, line(10), p, *fixed]) for s, p in zip(stamps, pages, strict=True)]
    alike = [f"It is a {line(3)}" for _ in range(8)]  # sentences, not a template
    texts += ["\n".join([line(12), line(11), x]) for x in alike]
    assert dropped(spark, texts) == [sorted([s, p, *fixed]) for s, p in zip(stamps, pages, strict=True)] + [[]] * 8


def test_url_rules(spark):
    urls = [f"http://{h}.example.{t}/{lang}/{n}" for h in "abc" for t in ("com", "net", "org") for lang in ("en", "de", "fr", "es") for n in range(3)]
    urls += ["x", None, "", "HTTP://A.NET", "http://net/", "https://sub.NET/p?q=1#f", "a://b", "http://xexample.net/en/1", "http://example.com/de/", "http://example.com/DE/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    found = url_rules.judged(df).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else r.verdict) and r.verdict in ("allow", "block")
    assert url_rules.judged(df.where("false")).count() == 0


def test_url_rules_keep_all_tokens(spark):
    keys = "a=1&b=2&c=3&d=4&e=5&"
    urls = [f"http://s{n}.example.net/x/{'ads' if n % 2 else 'en'}/{n}" for n in range(4)]
    urls += [f"http://h{n}.net/a/b/promo/{n}?{keys}utm_source=x" for n in range(30)] + [f"http://h{n}.org/fr/b/story/{n}?{keys}view=1" for n in range(30)]
    asked = ["http://q.info/z/z/promo", f"http://q.info/?{keys}utm_source=y", "http://q.info/z/z/story", f"http://q.info/?{keys}view=2"]
    df = spark.createDataFrame(list(enumerate(asked + urls)), "page_id long, url string")
    found = {r.page_id: (r.verdict, r.mined) for r in url_rules.judged(df).collect()}
    assert [found[i] for i in range(4)] == [("block", "p3:promo"), ("block", "q:utm_source"), ("allow", "p3:story"), ("allow", "q:view")]
    deep = spark.createDataFrame([("http://a.b.c.d.e/1x/y/z?k=1&k=2&&l",), ("x",), (None,)], "url string")
    u = deep["url"]
    got = [sorted(r.t) for r in deep.select(url_rules.tokens(u, url_rules.host_of(u), url_rules.path_of(u)).alias("t")).collect()]
    assert got == [sorted(["h:e", "h:d.e", "h:c.d.e", "h:b.c.d.e", "h:a.b.c.d.e", "p1:0x", "p2:y", "p3:z", "q:k", "q:l"]), [], []]


def test_lattice_hash(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 24))
    for i in range(60):
        v[i + 100] = v[i] + rng.normal(size=24) * rng.choice([0.1, 0.25, 0.4])
    v[200:215] = v[0]
    rows = [(i, x.tolist(), i % 2 if i < 90 else (i - 100) % 2) for i, x in enumerate(v)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [1.0] * 23 + [float("nan")], 1), (403, [1.0] * 23 + [None], 1), (404, v[0].tolist(), None), (405, [], 0), (406, [1.0, 2.0], 0), (407, (v[0] * 1e-200).tolist(), 0), (None, v[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {id(r): np.array(r[1]) / np.abs(r[1]).max() for r in good}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links = Counter()
    for a in good:
        for b in good:
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[id(a)] @ unit[id(b)] >= 0.93:
                links[a[0]] += 1
    for block in (4096, 8):
        found = {r.vec_id: r for r in lattice_hash.similar_vectors(df, block=block).collect()}
        assert len(found) == len(rows)
        assert sum(r.n_links for r in found.values()) >= 0.98 * sum(links.values()) and all(r.n_links <= links[k] for k, r in found.items())
        assert all(found[k].n_links == 0 and found[k].component_id == k and found[k].kept for k in (400, 401, 402, 403, 404, 405, 406))
        assert found[200].component_id == 0 and not found[200].kept and found[407].component_id == 0
    assert lattice_hash.digest(df.where("false")).count() == 0


def test_lattice_links_equal_sql(spark):
    """A made table with links, chains and hubs of clear similarity, by value against all pairs in SQL."""
    rng = np.random.default_rng(21)
    rows = []
    for dims, label in ((64, 0), (64, 1), (768, 2)):
        unit = lambda x: x / np.linalg.norm(x)
        for k in range(40):
            base = unit(rng.normal(size=dims))
            rows.append((len(rows), base.tolist(), label))
            for noise in [0.05, 0.15, 0.25][: k % 4]:  # cosines of about 0.999, 0.989 and 0.970
                rows.append((len(rows), (base + noise * unit(rng.normal(size=dims))).tolist(), label))
            if k % 7 == 0:
                rows.append((len(rows), (3 * base).tolist(), (label + 1) % 3))
            rows.append((len(rows), (base + 0.7 * unit(rng.normal(size=dims))).tolist(), label))  # about 0.82
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, None, 0), (len(rows) + 2, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6).cache()
    found = lattice_hash.digest(df)
    assert found.where("n_links > 0").count() > 150
    same_as_sql(spark, "op7_lattice_hash", found, embeddings=df)


@pytest.mark.parametrize("dims", (64, 768))
def test_lattice_recall_at_the_threshold(spark, dims):
    """Of pairs with a cosine of 0.931 to 0.935 at least 0.99 are found."""
    rng = np.random.default_rng(dims)
    n, rows = 600, []
    for k in range(n):
        a = rng.normal(size=dims)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dims)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.931, 0.935)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    assert lattice_hash.digest(df).where("n_links = 1").count() >= 0.99 * 2 * n


def test_nearest_lattice_point():
    x = np.random.default_rng(4).normal(size=(200, 8)) * 2
    first = lattice_hash.decode(x)[:, 0] / 2
    assert ((np.abs(first.sum(axis=1)) % 2) == 0).all()
    roots = [s for s in np.ndindex(*[3] * 8) if sum(abs(k - 1) for k in s) == 2]
    near = ((x - first) ** 2).sum(axis=1)
    for s in roots:
        assert (near <= ((x - first - (np.array(s) - 1)) ** 2).sum(axis=1) + 1e-9).all()


def plain_groups(texts, n, threshold):
    """Group numbers of texts by links of Jaccard similarity, and the sizes of their sets."""
    sets = []
    for t in texts:
        w = space_words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group, holders = list(range(len(texts))), defaultdict(list)
    for i, x in enumerate(sets):
        near = Counter(j for g in x for j in holders[g])
        for j, both in near.items():
            if 100 * both >= threshold * (len(x) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
        for g in x:
            holders[g].append(i)
    return group, [len(x) for x in sets]


def plain_templates(texts, least=5):
    """The places of the lines that each text loses, by the rule of line templates; families by the own lines of a text, else by its templates' leaves."""
    unsure = set()
    general = lambda t: "<*>" if re.search("[0-9]", t) else t
    lead_of = lambda x: tuple(general(t) for t in x.split(" ")[:3])
    lines = {t: [re.sub(r"[ \t\x0B\f\r]+", " ", x).strip(" ") for x in (t or "").split("\n")] for t in {t or "" for t in texts}}
    held = []  # text, place, leaf, line
    for t, own in lines.items():
        for k, x in enumerate(own):
            count = len(x.split(" "))
            if count >= 3 or len(x.encode()) >= 20:
                held.append((t, k, (count, lead_of(x)) if count >= 3 else x, x))
    reached = defaultdict(set)
    for t, _, leaf, _ in held:
        reached[leaf].add(t)
    held = [h for h in held if len(reached[h[2]]) >= least]
    docs = defaultdict(set)
    for t, _, leaf, x in held:
        docs[leaf, x].add(t)
    constant = Counter()
    for (leaf, x), who in docs.items():
        for k, token in enumerate(x.split(" ")):
            constant[leaf, k, token] += len(who)
    templates = defaultdict(set)
    for (leaf, x), who in docs.items():
        words = x.split(" ")
        fixed = [constant[leaf, k, t] >= least and not re.search("[0-9]", t) for k, t in enumerate(words)]
        free = sum(not f and not re.search("[0-9]", t) for f, t in zip(fixed, words, strict=True))
        if sum(fixed) > free and (free <= 1 or sum(fixed) >= 0.7 * (sum(fixed) + free)):
            templates[leaf, x].add(tuple(t if f else "<*>" for f, t in zip(fixed, words, strict=True)))
        if len(who) >= least:
            templates[leaf, x].add(x)
    tail_of = lambda x: tuple(x.split(" ")[-3:])
    tails, leaves = defaultdict(set), defaultdict(set)
    for t, own in lines.items():
        for x in filter(None, own):
            tails[tail_of(x)].add(t)
    for t, _, leaf, x in held:
        if templates[leaf, x]:
            leaves[t].add((leaf, x))
    family = {}
    for t, own in lines.items():
        in_template = {x for _, x in leaves[t]}
        alone = [x for x in own if x and x not in in_template and len(tails[tail_of(x)]) < least]
        decides = len(alone) > 1 or any(len(x.split(" ")) >= 3 for x in alone)
        family[t] = ("own", tuple(sorted(alone))) if decides else ("recurring", frozenset(leaf for leaf, _ in leaves[t]))
    kinds = defaultdict(lambda: defaultdict(set))
    for t, _, leaf, x in held:
        for template in templates[leaf, x]:
            kinds[leaf, template][family[t][0]].add(family[t][1])
    sizes = {k: (len(v["own"]), len(v["recurring"])) for k, v in kinds.items()}
    unsure.update(k for k, (n, m) in sizes.items() if n < least <= n + m and m > 1)  # marks may be fewer than sets
    recurring = {k for k, (n, m) in sizes.items() if n + m >= least}
    out = defaultdict(set)
    for t, k, leaf, x in held:
        if any((leaf, template) in recurring for template in templates[leaf, x]):
            out[t].add(k)
    doubtful = {t for t, _, leaf, x in held if any((leaf, template) in unsure for template in templates[leaf, x])}
    return [sorted(out[t or ""]) for t in texts], [(t or "") in doubtful for t in texts]


def without(text, places):
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in places)


def test_line_templates_against_the_plain_rule(spark, rows):
    line, rng = prose(random.Random(17)), random.Random(18)
    texts = [r[1] for r in rows]
    frames = ["Sign up for the weekly letter", "Page {} of {}", "Posted by {} on {} at the board", "All rights\treserved  here", "menu|about|contact|imprint|help", "ab", "It is a {} of the {} day", "{} {} {}"]
    for _ in range(150):
        own = [rng.choice(frames).format(*rng.choices(["7", "x1", "cat", "dog", "owl", "12.5"], k=3)) for _ in range(rng.randint(0, 4))]
        own += [line(rng.randint(1, 12)) for _ in range(rng.randint(0, 4))] + rng.choice([[], [""], ["  "]])
        rng.shuffle(own)
        texts += ["\n".join(own)] * rng.choice([1, 1, 1, 4])
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t, "n", 5) for k, t in enumerate(texts)], "doc_id long, text string, leaf string, n_lines int").repartition(5)
    wanted, doubtful = plain_templates(texts)
    assert sum(map(len, wanted)) > 100 and sum(doubtful) < len(texts) // 4
    found = {r.doc_id: r for r in line_templates.drop_templates(df).collect()}
    for k, (t, gone) in enumerate(zip(texts, wanted, strict=True)):
        if doubtful[k]:
            continue
        assert (found[k].n_dropped, found[k].text) == (len(gone), without(t, gone) if gone else t)


#: Headers as they stand in files, and the labels of each.
HEADERS = (
    ("This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.", "gpl,gpl-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gpl,lgpl,lgpl-2.1"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl,agpl-3.0,gpl"),
    ("# SPDX-License-Identifier: MIT\nimport os", "mit"),
    ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "isc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies", "epl-1.0"),
    ("are made available under the terms of the Eclipse Public License 2.0 which is available at", "epl-2.0"),
    ("We were permitted to use, copy and modify the plan for any purpose. The general license of the public house is version 2.", ""),
    ("licensed under the terms of the city council, version 3 of the license fee is hereby granted", ""),
)


def test_license_headers(spark):
    """Usual headers by their own labels, licences that differ in a word apart, prose about licences without any."""
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HEADERS)], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license_scan.digest(df).collect()}
    assert [found[k] for k in range(len(HEADERS))] == [labels for _, labels in HEADERS]


def test_url_keys_that_occur_together_are_one_class(spark):
    """Forty keys in common, and some more in fewer pages: rules are mined over classes, in the time of a few keys."""
    import time

    keys = "&".join(f"k{k}=1" for k in range(40))
    urls = [f"http://a.shop.net/x/{n}?{keys}" for n in range(60)] + [f"http://a.org/fr/{n}?{keys}&{'good=1' if n % 3 else 'sale=1'}" for n in range(60)]
    urls += [f"http://b.info/{n}?k{n}=2" for n in range(45)] + ["http://c.info/?k39=1&good=2", "http://c.info/?good=2", "http://c.info/?sale=1&k7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    found = {r.page_id: r for r in url_rules.judged(pages).collect()}
    assert time.time() - began < 60
    classes, rows = url_rules.token_classes(spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["c", "d"],)], "items array<string>"), 0.3)
    assert classes == [(["a", "b"], 2), (["c"], 2), (["d"], 1)] and rows == 3
    assert found[165].verdict == "allow" and found[166].verdict == "allow" and found[167].verdict == "allow"
    assert found[165].mined == "q:good" and found[167].mined == "q:sale"


def same_as_sql(spark, name, found, **tables):
    db = duckdb.connect()
    for k, df in tables.items():
        db.register(k, df.toArrow())
    sql = db.execute(sql_of()[name])
    columns = [d[0] for d in sql.description]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(columns) == sorted(found.columns)
    rows = Counter(tuple(text(r[c]) for c in columns) for r in found.collect())
    assert rows == Counter(tuple(map(text, r)) for r in sql.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op2_license_scan", "documents"), ("op5_ngram_jaccard_join", "documents"), ("op6_url_rules", "pages"), ("op7_lattice_hash", "embeddings"), ("op8_substring_dedup", "documents")])
def test_query_equals_sql(spark, name, table):
    sf = "/root/testdata/sf0.001"
    same_as_sql(spark, name, queries_of()[name](spark, sf), **{table: spark.read.parquet(f"{sf}/{table}.parquet")})


def test_url_rules_of_several_tokens_against_sql(spark):
    rng = random.Random(9)
    urls = [f"http://{h}.example.net/{p}/{n}" for h in "ab" for p in ("en", "x") for n in range(3)]
    urls += [f"http://shop.net/deals/{n}?ref={n}&promo" for n in range(20)] + [f"http://shop.org/fr/{n}?ref={n}" for n in range(20)] + [f"http://blog.org/fr/{n}?promo={n}" for n in range(20)] + [f"http://blog.net/post/{n}" for n in range(20)]
    urls += [f"http://{rng.choice(['q', 'z'])}.info/{rng.choice(['sale', 'x'])}/{n}?{rng.choice(['ref=1', 'k=2&k=3', 'ref&promo', ''])}" for n in range(30)]
    urls += ["http://q.info/sale/7?ref=1&promo=2", None, "", "x", "http://", "HTTP://A.B.info//deals/?=1&&ref", urls[0]]
    pages = spark.createDataFrame([(k % 140, u) for k, u in enumerate(urls)], "page_id long, url string")
    found = url_rules.judged(pages)
    same_as_sql(spark, "op6_url_rules", found, pages=pages)
    decided = {r.mined for r in found.collect() if r.mined}
    assert "q:promo q:ref" in decided  # neither token alone is as sure


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    hard = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "a few words", "en", "s", 11), (9003, "a few words", "en", "s", 11), (9004, "long " * 30_000, "en", "s", 150_000)]
    docs = source.union(spark.createDataFrame(hard, source.schema))
    step = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        step[name] = (docs.collect(), (after := spark.read.parquet(f"{tmp_path}/{k}")).collect())
        assert k == 4 or after.columns == source.columns
        docs = after
    # each stage against the plain rule on its own input
    before, after = step["toxicity"]
    judged = toxicity_crf.digest(spark.createDataFrame(before, source.schema), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in judged if not r.predicted) and len(after) < len(before)
    before, after = step["line dedup"]
    gone, _ = plain_templates([r.text for r in before])
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, without(r.text, g) if g else r.text) for r, g in zip(before, gone, strict=True))
    before, after = step["n-gram Jaccard join"]
    group, sizes = plain_groups([r.text for r in before], 5, 80)
    least = {}
    for g, n, r in zip(group, sizes, before, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id) if n else r.doc_id
    assert Counter(r.doc_id for r in after) == Counter([least[g] for g in {g for g, n in zip(group, sizes, strict=True) if n}] + [r.doc_id for r, n in zip(before, sizes, strict=True) if not n])
    before, after = step["benchmark decontamination"]
    bad = {r.doc_id for r in string_tiling.contaminated(spark.createDataFrame(before, source.schema), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id not in bad)
    before, after = step["packing"]
    ids, total = encode(), Counter()
    for r in after:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(ids(r.text)) for r in before}
    # empty tables and other columns
    for name in ("toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination"):
        assert stages[name](spark, source.where("false"), sf).count() == 0
    assert stages["packing"](spark, source.where("false"), sf).count() == 0
    same = stages["line dedup"](spark, source.withColumns({"_k1": F.lit(1), "leaf": F.lit("x")}), sf)
    assert same.columns == source.columns and same.count() == source.count()


def test_token_output_holds_two_blocks_at_most(spark):
    """Documents of a little over half a row: no two share a row, and yet rows leave and the packer's input stays bounded."""
    block, length = 1 << 14, 2048
    seen = []
    text = " ".join(["the"] * 1100)
    run = token_output._pack("word_bpe_49k.json", length, 1, 0, block)
    plain = token_output.best_fit_decreasing

    def spy(sizes, most):
        seen.append(int(sizes.sum()))
        return plain(sizes, most)

    token_output.best_fit_decreasing, context = spy, token_output.TaskContext
    token_output.TaskContext = type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))})
    try:
        batches = [pa.RecordBatch.from_arrays([pa.array([str(10 * k + i) for i in range(10)]), pa.array([text] * 10)], ["doc_id", "text"]) for k in range(30)]
        rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    finally:
        token_output.best_fit_decreasing, token_output.TaskContext = plain, context
    assert sorted(d for r in rows for d in r["doc_ids"]) == sorted(str(k) for k in range(300))
    assert len(seen) > 5 and max(seen) < 2 * block + 11_010
    assert token_output.handed_on([2048, 10, 2040, 500, 700], length, 600) == {1, 3}


def test_vector_packing_fills_sequences_with_short_texts(spark):
    docs = spark.createDataFrame([(str(k), "of the" if k % 7 else None) for k in range(9000)], "doc_id string, text string").coalesce(1)
    rows = vector_packing.packed_pieces(docs).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert sum(s == 2048 for s in size.values()) == sum(size.values()) // 2048
    assert all(s == 2048 or not s & (s - 1) for s in size.values()) and isinstance(rows[0].doc_id, str)


def test_examples_under_three_limits(spark, none):
    ids = encode()
    rng = random.Random(2)
    turns = [(c, t, "assistant" if t % 2 else "user", " ".join(["word", "more", "text"][rng.randrange(3)] for _ in range(rng.randint(0, 40)))) for c in range(300) for t in range(rng.randint(1, 6))]
    turns += [(300, 0, "user", None), (301, 1, None, "no role"), (302, 0, "assistant", " ".join(["long"] * 900)), (303, 0, "assistant", "tie"), (303, 0, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    limits = (400, 6, 150)
    found = vector_packing.packed_examples(vector_packing.conversations(df), limits=limits, block=4000).collect()
    wanted = {}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        wanted[c] = ([x for t in own for x in ids(t[3])], [int(t[2] == "assistant") for t in own for _ in ids(t[3])])
    sequences = defaultdict(list)
    for r in found:
        assert (np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.loss, np.uint8).tolist()) == wanted[r.example_id]
        assert (r.n_tokens, r.n_loss) == (len(wanted[r.example_id][0]), sum(wanted[r.example_id][1]))
        sequences[r.sequence_id].append(r)
    assert sorted(r.example_id for r in found) == sorted(wanted)
    bound = Counter()
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.n_tokens for r in s])[:-1]]
        used = (sum(r.n_tokens for r in s), len(s), sum(r.n_loss for r in s))
        assert len(s) == 1 or all(u <= m for u, m in zip(used, limits, strict=True))
        bound[max(range(3), key=lambda k: used[k] / limits[k])] += 1
    assert bound[0] + bound[2] > 5 and bound[2] > 0  # the loss limit binds somewhere
    assert len(sequences) <= 1.2 * max(sum(len(w[0]) for w in wanted.values()) / 400, len(wanted) / 6, sum(sum(w[1]) for w in wanted.values()) / 150) + 4
    assert vector_packing.packed_examples(vector_packing.conversations(df.where("false"))).count() == 0


def test_packed_conversations_query(spark):
    """Every conversation once, gapless within its sequence, no limit passed but by one example alone, and the loss limit binds."""
    sf = "/root/testdata/sf0.001"
    rows = queries_of()["packed_conversations"](spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert sorted(str(r.example_id) for r in rows) == sorted({str(t.conv_id) for t in turns})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    near = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.n_tokens for r in own])[:-1]]
        used = (sum(r.n_tokens for r in own), len(own), sum(r.n_loss for r in own))
        assert len(own) == 1 or all(u <= m for u, m in zip(used, vector_packing.LIMITS, strict=True))
        near += used[2] > 0.9 * vector_packing.LIMITS[2]
    assert near >= len(sequences) // 2


def plain_choice(items, limits):
    """Bins by the heuristic read word by word: of all that fit the largest dot product, the first seen type, its earliest example."""
    left, out = list(range(len(items))), []
    order = {}
    for i in reversed(left):
        order.setdefault(items[i], len(order))
    while left:
        room, row = list(limits), []
        while True:
            fits = [i for i in left if items[i][0] <= room[0] and room[1] >= 1 and items[i][1] <= room[2]]
            if not fits:
                break
            value = lambda i: items[i][0] * room[0] / limits[0] ** 2 + room[1] / limits[1] ** 2 + items[i][1] * room[2] / limits[2] ** 2  # noqa: B023, E731
            best = max(value(i) for i in fits)
            i = min((i for i in fits if value(i) >= best - 1e-12), key=lambda i: (order[items[i]], i))
            row.append(i)
            left.remove(i)
            room = [room[0] - items[i][0], room[1] - 1, room[2] - items[i][1]]
        out.append(row)
    return out


def test_choice_of_the_largest_dot_product():
    rng = random.Random(3)
    for _ in range(30):
        limits = (rng.randint(20, 90), rng.randint(2, 6), rng.randint(8, 40))
        items = [(n, rng.randint(0, min(n, limits[2]))) for n in (rng.randint(1, limits[0]) for _ in range(rng.randint(1, 40)))]
        found = vector_packing.pack(np.array([x[0] for x in items]), np.array([x[1] for x in items]), limits)
        assert found == plain_choice(items, limits)


def test_string_tiling_of_short_and_many_items(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(rng.randint(6, 30))] for _ in range(400)] + [["four", "words", "stand", "here"], ["single"]]
    shared = items[0][:6]
    items += [[*shared, *[word() for _ in range(n)]] for n in range(1, 9)]
    rows = [(k, " ".join([*[word() for _ in range(8)], *items[k], *[word() for _ in range(8)]])) for k in range(0, 400, 20)]
    rows += [(1000, "so Four words,\nstand here now"), (1001, "four words can stand here"), (1002, "a SINGLE word"), (1003, " ".join(" ".join(x) for x in items)), (1003, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, _k1 long, seed string, item_id string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(x), 7) for k, x in enumerate(items)] + [("again", " ".join(items[20]), 8), (None, "", 1)], "item_id string, text string, _k1 int")

    def plain(text, item):
        """Coverage by tiles of the brute-force algorithm."""
        d, w = re.findall(r"[a-z0-9]+", text.lower()), [x.lower() for x in item]
        least, used_w, used_d = min(5, len(w)), set(), set()
        if not {tuple(w[i : i + least]) for i in range(len(w) - least + 1)} & {tuple(d[i : i + least]) for i in range(len(d) - least + 1)}:
            return 0.0
        places = defaultdict(list)
        for j, x in enumerate(d):
            places[x].append(j)
        while True:
            best = (0, 0, 0)
            for i in range(len(w)):
                for j in places[w[i]]:
                    k = 0
                    while i + k < len(w) and j + k < len(d) and w[i + k] == d[j + k] and i + k not in used_w and j + k not in used_d:
                        k += 1
                    best = max(best, (k, -i, -j))
            if best[0] < least:
                return len(used_w) / len(w)
            used_w |= set(range(-best[1], -best[1] + best[0]))
            used_d |= set(range(-best[2], -best[2] + best[0]))

    wanted = Counter()
    for i, t in rows:
        for k, x in enumerate(items):
            share = plain(t, x)
            if share >= 0.8:
                wanted[i, f"i{k}", round(share, 9)] += 1
                if k == 20:
                    wanted[i, "again", round(share, 9)] += 1
    for pairs in (string_tiling.PAIRS, 50):  # a document with more items than one task takes
        string_tiling.PAIRS, before = pairs, string_tiling.PAIRS
        try:
            found = Counter((r.doc_id, r.item_id, round(r.coverage, 9)) for r in string_tiling.contaminated(docs, bench).collect())
        finally:
            string_tiling.PAIRS = before
        assert found == wanted
    assert {i for i, k, _ in wanted if k in ("i400", "i401")} == {1000, 1002, 1003}
    left = string_tiling.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1000, 1001, 1002}


def test_toxicity_sample_is_bounded_by_bytes(spark):
    rows = [(i, ("bad " if i % 2 else "good ") * (20_000 if i == 3 else 5)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5, "n") for i, t in rows], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    held = []
    real = toxicity_crf.Model

    class Spy:
        def __init__(self, texts, label):
            held.append((sum(len(t.as_py()) for t in texts), len(texts)))
            self.label = label

        def to_bytes(self):
            return real(pa.array([], pa.string()), np.zeros(0)).to_bytes()

    toxicity_crf.Model = Spy
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([i % 2 for i, _ in rows])], ["t", "y"])
        list(toxicity_crf._fit_here(5000)(iter([batch, batch])))
    finally:
        toxicity_crf.Model = real
    assert held[0][0] <= 5000 and held[0][1] > 100
    out = toxicity_crf.remove_toxic(docs, labels)
    assert out.columns == docs.columns and all("good" in r.text for r in out.collect())


def test_lattice_hash_labels_of_any_type(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(30, 16))
    near = [(x + 0.01 * rng.normal(size=16)).tolist() for x in v]
    for labels, kind in (((0.2, 0.7), "double"), (("a", "b"), "string")):
        rows = [(k, x.tolist(), labels[0]) for k, x in enumerate(v)] + [(100 + k, x, labels[k % 2]) for k, x in enumerate(near)]
        rows = [(i, x, c, "c", 5) for i, x, c in rows]
        found = {r.vec_id: r for r in lattice_hash.similar_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}, cell string, k int")).collect()}
        assert [found[100 + k].component_id for k in range(30)] == [100 + k if k % 2 else k for k in range(30)]
    zero = spark.createDataFrame([(0, v[0].tolist(), 0.0), (1, near[0], -0.0)], "vec_id long, embedding array<double>, label double")
    assert {r.component_id for r in lattice_hash.similar_vectors(zero).collect()} == {0}


def test_substring_dedup_of_a_hot_passage(spark):
    """One passage in most documents over many tasks: no hash is sent more than a few times by a task, and rows are as by brute force."""
    line = prose(random.Random(31))
    passage = line(40).split()
    texts = [" ".join([*line(9).split(), *passage, *line(6).split()]) if k % 3 else line(60) for k in range(240)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(240), pa.int64()), pa.array(range(240), pa.int64()), pa.array(texts)], ["_k1", "_k2", "text"])
    sent = Counter(h for b in substring_dedup._anchors(35)(iter([batch, batch])) for h, t in zip(b.column("hash").to_pylist(), b.column("tail").to_pylist()) if t >= 0)
    assert max(sent.values()) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.digest(df).collect()}
    assert removed == {k: 40 if k % 3 else 0 for k in range(240)}
