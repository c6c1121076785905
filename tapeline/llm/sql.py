"""The same results in DuckDB SQL, for the queries that SQL can state: brute force over words, shingles, windows and pairs."""

from __future__ import annotations

from .importance_resampling import BUCKETS, LEAST_WORDS, ORDERS, PERCENT, SEED
from .license_scan import BASE, LEAST_MATCH, TEMPLATES
from .substring_dedup import WINDOW
from .url_rules import DEFAULT, MIN_CONFIDENCE, MIN_SUPPORT, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, cut: str) -> str:
    """Steps d (row r, doc_id, words w) and words (r, place i from 0, word x)."""
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({text}, '{cut}'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d)"""


def _runs(n: int) -> str:
    """Step runs: the n words from each place on, as one text."""
    frame = f"OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"runs AS (SELECT r, i, g FROM (SELECT r, i, string_agg(x, ' ') {frame} AS g, count(*) {frame} AS n FROM words) AS f WHERE n = {n})"


def _components(links: str, ids: str) -> str:
    """Steps links (a, b, both ways) and least (a, the smallest id that is reachable)."""
    return f"links AS ({links}), reach AS (SELECT id AS a, id AS b FROM {ids} UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"


def op2_license_scan() -> str:
    def at(o: str, word: str) -> str:
        return f"coalesce(CASE WHEN {o} >= 0 THEN w[{o} + 1] = '{word}' END, false)"

    base = [f"SELECT r, i, '{label}' AS label FROM words JOIN d USING (r) WHERE x = '{p.split()[0]}' AND " + " AND ".join(at(f"(i + {k})", x) for k, x in enumerate(p.split())) for p, label in BASE.items()]
    found = []
    for label, statement, phrases in TEMPLATES:
        s = statement.split()
        keys = [next(i for i in range(len(s)) if s[i : i + len(p.split())] == p.split()) for p in phrases]
        stands = " AND ".join(at(f"(o + {b + k})", x) for b, p in zip(keys, phrases, strict=True) for k, x in enumerate(p.split()))
        score = f"({' + '.join(f'CAST({at(f"(o + {k})", x)} AS INTEGER)' for k, x in enumerate(s))}) / {len(s)}.0::DOUBLE"
        found.append(f"SELECT r, '{label}' AS label, {score} AS score FROM (SELECT r, i - {keys[0]} AS o, w FROM words JOIN d USING (r) WHERE x = '{s[keys[0]]}') AS c WHERE {stands}")
    return (
        _words(_LOWER, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        + f", base AS ({' UNION ALL '.join(base)}), found AS (SELECT * FROM ({' UNION ALL '.join(found)}) AS f WHERE score >= {LEAST_MATCH}::DOUBLE)"
        + """, b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
m AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) AS u GROUP BY r), s AS (SELECT r, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN s USING (r)"""
    )


def op5_ngram_jaccard_join(n: int = 4, threshold: int = 85) -> str:
    links = f"SELECT a, b FROM (SELECT p.r AS a, q.r AS b, count(*) AS c FROM sets AS p JOIN sets AS q USING (g) WHERE p.r <> q.r GROUP BY p.r, q.r) AS x JOIN sizes AS s ON s.r = a JOIN sizes AS t ON t.r = b WHERE 100 * c >= {threshold} * (s.n + t.n - c)"
    return (
        _words(_LOWER, r"[\x20\x09-\x0D]+")
        + f", {_runs(n)}, sets AS (SELECT DISTINCT r, g FROM runs UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {n - 1}), sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r), "
        + _components(links, "(SELECT r AS id FROM sizes) AS ids")
        + ", named AS (SELECT reach.a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a) SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN sizes USING (r) LEFT JOIN named ON named.a = d.r"
    )


def op7_lattice_hash(threshold: float = 0.93) -> str:
    usable = "label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0"
    links = f"SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p JOIN v AS q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= {threshold}::DOUBLE"
    return (
        f"WITH RECURSIVE v AS (SELECT * FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) AS x WHERE {usable}), "
        + _components(links, "(SELECT vec_id AS id FROM embeddings) AS ids")
        + " SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS c ON c.a = vec_id"
    )


def op8_substring_dedup(window: int = WINDOW) -> str:
    return (
        _words("coalesce(text, '')", r"[\x20\x09-\x0D]+")
        + f", {_runs(window)}, hot AS (SELECT r, i FROM runs JOIN (SELECT g FROM runs GROUP BY g HAVING count(*) > 1) AS x USING (g)),"
        + f"""marked AS (SELECT r, i, x, max(CASE WHEN hot.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN hot USING (r, i)),
left_over AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)"""
    )


def op6_url_rules() -> str:
    """All item sets of the labelled pages are counted; of the rules that hold in a page the best one judges it."""
    fixed = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in fixed]
    rule = " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, fixed, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, fixed, strict=True))
    return rf"""WITH p AS (SELECT row_number() OVER () AS r, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS fixed, list_sort(list_distinct(list_concat(CASE WHEN host <> '' THEN list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: 'h:' || array_to_string(list_slice(string_split(host, '.'), -k, -1), '.')) ELSE [] END,
    list_filter(list_transform(range(1, len(string_split(path, '/'))), lambda k: CASE WHEN string_split(path, '/')[k + 1] <> '' THEN 'p' || k || ':' || regexp_replace(string_split(path, '/')[k + 1], '[0-9]+', '0', 'g') END), lambda x: x IS NOT NULL),
    list_filter(list_transform(string_split(coalesce(regexp_extract(url, '(?s)\?([^#]*)', 1), ''), '&'), lambda x: 'q:' || split_part(x, '=', 1)), lambda x: x <> 'q:')))) AS items FROM p),
l AS (SELECT r, fixed, items FROM t WHERE fixed IS NOT NULL), total AS (SELECT count(*) AS n FROM l),
subsets AS (SELECT fixed, list_filter(items, lambda x, k: (mask >> (k - 1)) & 1 = 1) AS own FROM (SELECT *, unnest(range(1, 1 << len(items))) AS mask FROM l) AS m),
counted AS (SELECT own, count(*) AS n FROM subsets GROUP BY own), both_counted AS (SELECT own, fixed, count(*) AS n FROM subsets GROUP BY own, fixed),
rules AS (SELECT own, b.fixed AS verdict, b.n / c.n::DOUBLE AS confidence, b.n / total.n::DOUBLE AS support FROM both_counted AS b JOIN counted AS c USING (own), total WHERE b.n >= ceil({MIN_SUPPORT}::DOUBLE * total.n) AND b.n / c.n::DOUBLE >= {MIN_CONFIDENCE}::DOUBLE),
kept AS (SELECT * FROM rules AS r WHERE NOT EXISTS (SELECT 1 FROM rules AS s WHERE s.verdict = r.verdict AND len(s.own) < len(r.own) AND list_has_all(r.own, s.own) AND s.confidence >= r.confidence)),
best AS (SELECT r, first(verdict ORDER BY confidence DESC, support DESC, len(own) DESC, own, verdict) AS verdict, array_to_string(first(own ORDER BY confidence DESC, support DESC, len(own) DESC, own, verdict), ' ') AS mined FROM t JOIN kept ON list_has_all(items, own) WHERE fixed IS NULL GROUP BY r)
SELECT page_id, host, path, rule, coalesce(fixed, verdict, '{DEFAULT}') AS verdict, mined FROM t LEFT JOIN best USING (r)"""


def op13_importance_resampling() -> str:
    """crc32 by its table of 256 values, for each distinct run of words once."""
    low, cut = _LOWER, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def runs(name: str, ident: str, table: str) -> str:
        some = " UNION ALL ".join(f"SELECT r, array_to_string(w[i:i + {k}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1 - {k})) AS i FROM {name}_d) AS x" for k in range(ORDERS))
        return f"{name}_d AS (SELECT row_number() OVER () AS r, {ident}list_filter(string_split_regex({low}, '{cut}'), lambda x: x <> '') AS w FROM {table}), {name}_runs AS ({some})"

    step = "xor(c >> 1, (c & 1) * 3988292384)"
    byte = "c"
    for _ in range(8):
        byte = f"list_transform({byte}, lambda c: {step})" if byte != "c" else f"list_transform(range(256), lambda c: {step})"
    bytes_of = "list_transform(range(1, strlen(g) + 1), lambda i: CAST('0x' || hex(g)[2 * i - 1:2 * i] AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
    return f"""WITH {runs("raw", "doc_id, ", "documents")}, {runs("goal", "", "benchmark")}, crc AS (SELECT {byte} AS t),
hashed AS MATERIALIZED (SELECT g, {crc} % {BUCKETS} AS b FROM (SELECT g FROM raw_runs UNION SELECT g FROM goal_runs) AS u, crc),
s AS (SELECT b, count(*) AS s FROM raw_runs JOIN hashed USING (g) GROUP BY b), t AS (SELECT b, count(*) AS t FROM goal_runs JOIN hashed USING (g) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
per AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM raw_runs JOIN hashed USING (g) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM raw_d LEFT JOIN per USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE n_words >= {LEAST_WORDS} QUALIFY rank <= count(*) OVER () * {PERCENT} // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)"""
