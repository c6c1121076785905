"""URL filter by association rules.

Fixed rules label pages: a rule (host, path, verdict) fits its host and all subdomains if the URL's
path starts with the rule's; the longest wins. From the pages that they label, FP-growth mines sets
of URL tokens (all suffixes of the host, path segments and query keys) together with the verdict; rules
``tokens -> verdict`` are kept from MIN_SUPPORT and MIN_CONFIDENCE on, and dropped if a shorter rule
of the same verdict is as confident. A page without a fixed rule takes the verdict of the most
confident mined rule (then of the larger support, the longer, the smaller in order) that its tokens
hold, found by an inverted index: from each token to its rules, and a rule matches when all its
tokens are counted. Without any, the verdict is DEFAULT.

All tokens are counted first, and those below the support threshold go: what is left is bounded by that threshold and the
tokens of a mean page, not by the pages. Tokens that hold in exactly the same labelled pages are one class, known by the count and two
hashes of these pages, and FP-growth mines over classes: a set with two tokens of one class is as confident
as without one of them, so it would be dropped, while each choice of one token from each class is as good as any other. A
page matches a class by any of its tokens, and the rule is named by the smallest that it holds. Tokens of all labelled pages
change no confidence, so they are rules on their own only. Very long URLs are read whole; columns of the input other
than the two named ones aren't read, whatever their names. Defined
cases: a null URL or one without ``://`` has empty host and path; equal pages are judged alike, each
row for itself; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.01, 0.6, "allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(_part(url, r"(?s)^.*?://([^/?#]*)"), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return _part(url, r"(?s)^.*?://[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host suffixes, path segments with their place, query keys; digits of segments are one kind."""
    labels = F.split(host, r"\.")
    suffix = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -k, k), "."))))
    parts = F.transform(F.split(path, "/"), lambda x, k: F.when((k > 0) & (x != ""), F.concat(F.lit("p"), k, F.lit(":"), F.regexp_replace(x, "[0-9]+", "0"))))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(suffix, none), parts, F.array_remove(keys, "q:"))))


def token_classes(labelled: DataFrame, min_support: float) -> tuple[list[tuple[list[str], int]], int]:
    """(tokens, pages) of each class of tokens that hold in the same rows and reach the threshold, and the number of rows."""
    rows = labelled.count()
    each = labelled.withColumn("_row", F.monotonically_increasing_id()).select(F.explode("items").alias("x"), F.xxhash64("_row").alias("a"), F.xxhash64("_row", F.lit(7)).alias("b"))
    held = each.groupBy("x").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= math.ceil(min_support * rows))
    classes = held.groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("x")).alias("tokens"))  # at most tokens of a mean row / min_support
    return sorted((r.tokens, r.n) for r in classes.select("tokens", "n").collect()), rows


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[tuple[str, ...], ...], str, float, float]]:
    """(classes of tokens, verdict, confidence, support) mined from rows (items, verdict), pruned; bounded by the support threshold."""
    classes, rows = token_classes(labelled, min_support)
    if not classes:
        return []
    member = F.create_map(*[F.lit(v) for k, (own, n) in enumerate(classes) for x in own for v in (x, str(k))])
    named = F.array_distinct(F.array_compact(F.transform("items", lambda x: F.try_element_at(member, x))))
    everywhere = [str(k) for k, (_, n) in enumerate(classes) if n == rows]
    some = F.array_except(named, F.array(*[F.lit(k) for k in everywhere]).cast("array<string>"))
    baskets = labelled.select(F.concat(some, F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    found = [(r.antecedent, r.consequent[0][1:], r.confidence, r.support) for r in _associations(baskets, min_support, min_confidence).collect()]
    if everywhere:
        share = {r.verdict: r["count"] / rows for r in labelled.groupBy("verdict").count().collect()}
        found += [([k], v, p, p) for k in everywhere for v, p in share.items() if p >= min_confidence]
    found = [(tuple(tuple(classes[int(k)][0]) for k in sorted(own, key=int)), *rest) for own, *rest in found]
    confidences: dict[tuple[frozenset, str], float] = {}
    kept = []
    for own, verdict, confidence, support in sorted(found, key=lambda r: (len(r[0]), r[0], r[1])):
        below = (confidences.get((frozenset(s), verdict), 0.0) for k in range(1, len(own)) for s in itertools.combinations(own, k))
        if max(below, default=0.0) < confidence:
            confidences[frozenset(own), verdict] = confidence
            kept.append((own, verdict, confidence, support))
    return kept


def _associations(baskets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    return model.associationRules.where(F.element_at("consequent", 1).startswith("=")).where(~F.exists("antecedent", lambda x: x.startswith("=")))


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined: the mined rule that decided."""
    u = F.col("url")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of(u), "path": path_of(u)})
    base = base.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("items", tokens(u, F.col("host"), F.col("path")))
    kept = mined_rules(base.where("fixed is not null").select("items", F.col("fixed.verdict").alias("verdict")))
    if not kept:
        return base.select("page_id", "host", "path", "fixed.rule", F.coalesce("fixed.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    # the inverted index: from a token to its class, from a class to its rules
    number = {c: k for k, c in enumerate(sorted({c for own, *_ in kept for c in own}))}
    postings: dict[int, list[int]] = {}
    for k, (own, *_) in enumerate(kept):
        for c in own:
            postings.setdefault(number[c], []).append(k)
    member = F.create_map(*[F.lit(v) for c, k in number.items() for x in c for v in (x, k)])
    index = F.array(*[F.array(*map(F.lit, postings[k])) for k in range(len(number))])
    score = F.array(*[F.struct(F.lit(-r[2]).alias("c"), F.lit(-r[3]).alias("s"), F.lit(-len(r[0])).alias("n")) for r in kept])
    verdicts, parts = F.array(*[F.lit(r[1]) for r in kept]), F.array(*[F.array(*[F.lit(number[c]) for c in r[0]]) for r in kept])
    none = F.array().cast("array<int>")
    held = F.transform("items", lambda x: F.struct(F.try_element_at(member, x).alias("class"), x.alias("token")))
    out = base.withColumn("held", F.when(F.col("fixed").isNull(), F.filter(held, lambda x: x["class"].isNotNull())))
    out = out.withColumn("hits", F.flatten(F.transform(F.array_distinct(F.col("held")["class"]), lambda c: F.coalesce(F.get(index, c), none))))
    whole = F.filter(F.array_distinct("hits"), lambda k: F.size(F.filter("hits", lambda y: y == k)) == F.size(F.get(parts, k)))
    out = out.withColumn("whole", whole)
    top = F.array_min(F.transform("whole", lambda k: F.get(score, k)))
    name = lambda k: F.sort_array(F.transform(F.get(parts, k), lambda c: F.array_min(F.filter("held", lambda x: x["class"] == c)["token"])))
    out = out.withColumn("top", top).withColumn("best", F.array_min(F.transform(F.filter("whole", lambda k: F.get(score, k) == F.col("top")), lambda k: F.struct(name(k).alias("name"), F.get(verdicts, k).alias("verdict")))))
    return out.select("page_id", "host", "path", "fixed.rule", F.coalesce("fixed.verdict", "best.verdict", F.lit(default)).alias("verdict"), F.array_join("best.name", " ").alias("mined"))


def digest(pages: DataFrame) -> DataFrame:
    """Result of op6."""
    return judged(pages)
