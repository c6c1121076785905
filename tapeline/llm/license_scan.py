"""Licence scans by a positional rare-token index, in DataFrame operations only.

Templates are licence statements and the openings of licence headers and texts; licences that differ in a word (a version, "lesser",
"sharealike") are kept apart by key phrases that hold that word. Words are ranked by inverse document frequency, counted over
all documents. As a template's mandatory key phrases must stand exactly, its rarest word in them is
at its place wherever the template matches, so the index has this one place of each template, however
common the word is. All indexed words are looked up in every document; their places minus the
postings' places give alignments. There the whole template is compared, and its key phrases must stand. A template without
key phrases is indexed by so many of its rarest places that a match has one of them. Base phrases are
matched on their own, wherever their words stand consecutively.

Words are the ranges of ASCII letters and digits and of all other characters, after A-Z are lower
case. Defined cases: null text is empty; all rows are kept one by one; other columns are ignored. Very long texts
are scanned whole; of several matches each label counts once, and the score is the best one's; an empty table gives no
rows. Columns of the input that are named as results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dist import hidden

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licences by their SPDX identifiers, as words, and the label of each.
SPDX = {
    "mit": "mit", "isc": "isc", "unlicense": "unlicense", "cc0 1 0": "cc0", "apache 2 0": "apache-2.0",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0",
    "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 3 0": "agpl-3.0",
    "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nd 4 0": "cc-by-nd-4.0",
}
_GNU = "it under the terms of the gnu {} as published by the free software foundation either version {} of the license"
#: Statements of licences and the openings of their headers and texts, in words: label, statement, mandatory key phrases.
STATEMENTS = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("isc", "licensed under the isc license", ("isc license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", _GNU.format("general public license", "2"), ("gnu general public license", "version 2 of the license")),
    ("gpl-3.0", _GNU.format("general public license", "3"), ("gnu general public license", "version 3 of the license")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl-2.1", _GNU.format("lesser general public license", "2 1"), ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3.0", _GNU.format("lesser general public license", "3"), ("gnu lesser general public license", "version 3 of the license")),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("agpl-3.0", _GNU.format("affero general public license", "3"), ("gnu affero general public license", "version 3 of the license")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution license",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution share alike 4 0 international license", ("creative commons attribution share alike 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0",)),
    ("cc0", "released under creative commons zero cc0 public domain dedication", ("public domain",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", ("eclipse public license v1 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Templates: the statements, and a line for each identifier, which must stand whole.
TEMPLATES = (*STATEMENTS, *[(label, f"spdx license identifier {x}", (f"spdx license identifier {x}",)) for x, label in SPDX.items()])
LEAST_MATCH = 0.6
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() differs from A-Z only where it makes an ASCII letter of another character: the Kelvin sign
    low = F.when(F.contains(text, F.lit("K")), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _DELIMITERS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """Share of all documents that hold each word of the vocabulary (its size bounds what is collected)."""
    found = docs.select(F.explode(F.array_intersect(_strings(vocabulary), words(F.col(text)))).alias("w")).groupBy("w").count()
    total = max(1, docs.count())
    return {r.w: r["count"] / total for r in found.collect()}


def _key_places(statement: str, phrases) -> list[int]:
    """Where each key phrase stands in the statement."""
    s = statement.split()
    return [next(i for i in range(len(s)) if s[i : i + len(k.split())] == k.split()) for k in phrases]


def anchors(templates, share: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, template, place): of each template the rarest places such that every match has one of them."""
    out = []
    for t, (_, statement, phrases) in enumerate(templates):
        s = statement.split()
        key = {at + i for at, k in zip(_key_places(statement, phrases), phrases, strict=True) for i in range(len(k.split()))}
        n = 1 if key else len(s) - next(k for k in range(len(s) + 1) if k / len(s) >= LEAST_MATCH) + 1
        out += [(s[p], t, p) for p in sorted(key or range(len(s)), key=lambda p: (share.get(s[p], 0.0), s[p], p))[:n]]
    return out


def scanned(docs: DataFrame, text: str = "text", templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """``docs`` (columns of these names give way) with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    share = document_frequency(docs, text, vocabulary)
    postings = anchors(templates, share)
    rare = sorted({w for w, _, _ in postings})
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in postings])
    texts = F.array(*[_strings(statement.split()) for _, statement, _ in templates])
    keys = []
    for _, statement, phrases in templates:
        at = _key_places(statement, phrases)
        keys.append(F.array(*[F.struct(F.lit(i).alias("at"), _strings(k.split()).alias("w")) for i, k in zip(at, phrases, strict=True)]))
    mandatory = F.array(*keys)
    names = _strings([label for label, _, _ in templates])

    inner, own = hidden(docs)
    out = inner.withColumn("_w", words(F.col(own[text])))
    w = F.col("_w")
    out = out.withColumn("_rare", F.array_intersect(_strings(rare), w))
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: F.array_contains(F.col("_rare"), h["w"]))
    out = out.withColumn("_hits", F.when(F.size("_rare") > 0, hits))
    aligned = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.transform(F.filter(index, lambda p: p["w"] == h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))))
    out = out.withColumn("_at", aligned)

    def stands(c: Column) -> Column:
        return F.forall(F.get(mandatory, c["t"]), lambda k: F.forall(F.transform(k["w"], lambda x, j: F.coalesce(F.get(w, c["o"] + k["at"] + j) == x, F.lit(False))), lambda ok: ok))

    def match(c: Column) -> Column:
        same = F.filter(F.transform(F.get(texts, c["t"]), lambda x, j: F.coalesce(F.get(w, c["o"] + j) == x, F.lit(False))), lambda ok: ok)
        return F.size(same) / F.size(F.get(texts, c["t"]))

    found = F.filter(F.transform(F.filter("_at", stands), lambda c: F.struct(F.get(names, c["t"]).alias("label"), match(c).alias("score"))), lambda x: x["score"] >= LEAST_MATCH)
    out = out.withColumn("_found", F.coalesce(found, F.array().cast("array<struct<label:string,score:double>>")))

    out = out.withColumn("_base", F.concat(*[_places(w, phrase.split(), label) for phrase, label in base.items()]))
    base_labels = F.array_distinct(F.col("_base")["label"])
    labels = F.array_distinct(F.concat(base_labels, F.col("_found")["label"]))
    best = F.coalesce(F.array_max(F.col("_found")["score"]), F.lit(0.0))
    fresh = {
        "n_words": F.size(w).cast("long"),
        "n_base": F.size("_base").cast("long"),
        "first_word": F.array_min(F.col("_base")["i"]).cast("long"),
        "last_word": F.array_max(F.col("_base")["i"]).cast("long"),
        "base_labels": F.array_join(F.array_sort(base_labels), ","),
        "labels": F.array_join(F.array_sort(labels), ","),
        "score": F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best),
    }
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if c not in fresh], *[v.alias(k) for k, v in fresh.items()])


def _places(w: Column, phrase: list[str], label: str) -> Column:
    """Where the words of ``phrase`` stand consecutively: (place, label)."""

    def stands(i: Column) -> Column:
        out = F.lit(True)
        for k, x in enumerate(phrase):
            out = out & (F.get(w, i + k) == x)
        return out

    hits = F.filter(F.sequence(F.lit(0), F.size(w) - len(phrase)), stands)
    hits = F.transform(hits, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))
    possible = (F.size(w) >= len(phrase)) & F.array_contains(w, max(phrase, key=len))
    return F.when(possible, hits).otherwise(F.array().cast("array<struct<i:int,label:string>>"))


def digest(docs: DataFrame) -> DataFrame:
    """Result of op2."""
    return scanned(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
