"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line goes by its number of tokens (runs of white space cut them, those around the
line don't count), then by its first LEAD tokens (tokens with digits are variable fields there); a line
of fewer than ``least_tokens`` tokens, but of LEAST_BYTES or more, goes by its whole text. In each leaf that lines of several documents reach,
a token is constant at its place if several documents have it there; all others are variable fields.
What remains is the line's template. It counts if of its tokens without digits the fixed ones are more
than the others, and ``least_constant`` of them at least or all but one: fields with digits may be any
number. A line that recurs verbatim is a template as well, whatever its tokens are. A template is dropped, with all its lines, if it recurs in
``least_docs`` families of documents or more.

Documents are counted by distinct text, and families by what sets a document apart from all others: its own lines, which
no template holds and whose last LEAD tokens are not those of lines of ``least_docs`` documents. A document with own lines, two at least or
one of ``least_tokens`` tokens, is a family by them, whatever else it has: so a notice may be much longer than the pages that
bear it. A document without is made of what recurs, like a copy of which a few words were changed: a changed line stays in
its template, or keeps its last tokens. Such documents are told apart by three marks, each the least hash of the leaves of their
templates' lines; of the three counts of distinct marks the middle one holds. Copies differ in few lines, so their marks
hardly differ, and the lines of copied documents stay, as whole documents are another operator's task.

Defined cases: null text is empty; shorter lines of fewer than ``least_tokens`` tokens stay; a document that
loses all lines becomes empty, and its row stays; equal rows count as one document; very long texts are read whole, line by line;
templates that reach ``least_docs`` exactly are dropped; an empty table gives no rows; other columns pass, but for those
named as the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dist import Scratch, joined
from .substring_dedup import text_key

LEAD, LEAST_DOCS, LEAST_TOKENS, LEAST_CONSTANT = 3, 5, 3, 0.7
LEAST_BYTES = 20
FIELD, MARKS = "<*>", 3


def _general(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _even(text: Column) -> Column:
    """The text with single spaces for runs of white space within its lines."""
    uneven = F.lit(False)
    for x in ("  ", "\t", "\x0b", "\f", "\r"):
        uneven = uneven | F.contains(text, F.lit(x))
    return F.when(uneven, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)


def _lead(line: Column) -> Column:
    tokens = F.split(line, " ", LEAD + 1)
    return F.xxhash64(*[_general(F.get(tokens, F.lit(k))) for k in range(LEAD)])


def _families(lines: DataFrame, tails: DataFrame, rows: int, templates: DataFrame, least_tokens: int) -> DataFrame:
    """One row for each text: family (of its own lines; null if it has too few), and marks of its templates' leaves (null if it has a family)."""
    fixed = templates.select("leaf", "line", F.lit(True).alias("held")).distinct()
    both = joined(lines, tails.select(F.col("h").alias("tail"), F.lit(True).alias("recurs")), rows, 16, ["tail"], "left").join(fixed, ["leaf", "line"], "left")
    own = F.col("held").isNull() & F.col("recurs").isNull()
    least = [F.min(F.when(F.col("held"), F.xxhash64("leaf", F.lit(k)))).alias(f"mark{k}") for k in range(MARKS)]
    per = both.groupBy("_k1", "_k2").agg(F.count_if(own).alias("n"), F.max(F.when(own, F.col("count"))).alias("longest"), F.bit_xor(F.when(own, F.col("line"))).alias("sum"), *least)
    decides = F.coalesce((F.col("n") > 1) | (F.col("longest") >= least_tokens), F.lit(False))
    marks = [F.when(~decides, F.coalesce(f"mark{k}", F.lit(0))).alias(f"mark{k}") for k in range(MARKS)]
    return per.select("_k1", "_k2", F.when(decides, F.xxhash64("n", "sum")).alias("family"), *marks)


def dropped_lines(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, least_constant: float = LEAST_CONSTANT) -> DataFrame:
    """One row for each distinct text that loses lines: its key (_k1, _k2) and the places of these lines (from 0)."""
    scratch = Scratch(docs.sparkSession)
    # keys are worked out below the explode, once for each document
    whole = docs.select(*text_key(text), F.transform(_lines(_even(F.col(text))), lambda x: F.trim(x)).alias("lines"))
    lines = whole.select("_k1", "_k2", F.posexplode("lines").alias("place", "text")).where("text <> ''")
    count = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumns({"count": count, "lead": _lead(F.col("text")), "line": F.xxhash64("text")})
    leaf = F.when(F.col("count") >= least_tokens, F.xxhash64("count", "lead")).when(F.octet_length("text") >= LEAST_BYTES, F.xxhash64("text", F.lit("leaf")))
    lines = lines.withColumn("leaf", leaf)
    # hashes of all lines are kept; texts are read again only of lines whose leaf recurs
    marked = scratch.table(lines.select("_k1", "_k2", "count", "leaf", F.xxhash64(F.substring_index("text", " ", -LEAD), F.lit("tail")).alias("tail"), "line"))

    seen = marked.select("_k1", "_k2", F.explode(F.array("leaf", "tail")).alias("h")).where("h is not null")
    shared = seen.groupBy("h", "_k1", "_k2").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n")).where(F.col("n") >= least_docs).select("h")
    shared = scratch.table(shared)
    rows = shared.count()
    held = joined(lines.where("leaf is not null"), shared.withColumnRenamed("h", "leaf"), rows, 16, ["leaf"], "inner")
    held = scratch.table(held.select("_k1", "_k2", "place", "leaf", "line", "text"))

    distinct = held.groupBy("leaf", "line").agg(F.min("text").alias("text"))
    tokens = distinct.select("leaf", "line", F.posexplode(F.split("text", " ")).alias("at", "token"))
    carried = held.groupBy("leaf", "line", "_k1", "_k2").agg(F.lit(1).alias("one")).groupBy("leaf", "line").agg(F.count("one").alias("docs"))
    # documents that have a token at a place: at most counted twice if one document has it in two lines
    constant = tokens.join(carried, ["leaf", "line"]).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).where(~F.col("token").rlike("[0-9]"))
    masked = tokens.join(constant.select("leaf", "at", "token", F.lit(True).alias("fixed")), ["leaf", "at", "token"], "left")
    shape = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("token")).otherwise(FIELD).alias("token"))))
    free = F.count_if(F.col("fixed").isNull() & ~F.col("token").rlike("[0-9]"))
    templates = masked.groupBy("leaf", "line").agg(F.xxhash64(shape).alias("template"), F.count("fixed").alias("fixed"), free.alias("free"))
    templates = templates.where((F.col("fixed") > F.col("free")) & ((F.col("free") <= 1) | (F.col("fixed") >= least_constant * (F.col("fixed") + F.col("free")))))
    verbatim = carried.where(F.col("docs") >= least_docs).select("leaf", "line", F.xxhash64("line", F.lit("verbatim")).alias("template"))
    templates = scratch.table(templates.select("leaf", "line", "template").union(verbatim))

    families = _families(marked, shared, rows, templates, least_tokens)
    marks = [f"mark{k}" for k in range(MARKS)]
    used = held.join(templates, ["leaf", "line"]).select("leaf", "template", "_k1", "_k2").distinct()
    used = used.join(families, ["_k1", "_k2"]).select("leaf", "template", "family", *marks).distinct()
    recurring = used.groupBy("leaf", "template").agg(F.count_distinct("family").alias("own"), *[F.count_distinct(c).alias(c) for c in marks])
    recurring = recurring.where(F.col("own") + F.sort_array(F.array(*marks))[MARKS // 2] >= least_docs).select("leaf", "template")
    gone = templates.join(recurring, ["leaf", "template"]).select("leaf", "line").distinct()
    out = held.join(gone, ["leaf", "line"]).groupBy("_k1", "_k2").agg(F.collect_set("place").alias("places"))
    return scratch.table(out)


def drop_templates(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with ``text`` without the lines of recurring templates, and n_lines, n_dropped (clashing names of the input give way)."""
    gone = dropped_lines(docs, text, **options).withColumnRenamed("_k1", "_g1").withColumnRenamed("_k2", "_g2")
    keyed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], *text_key(text))
    both = keyed.join(gone, (F.col("_k1") == F.col("_g1")) & (F.col("_k2") == F.col("_g2")), "left")
    at = docs.columns.index(text)
    lines = _lines(F.col(f"c{at}"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("places"), i)), "\n")
    new = F.when(F.col("places").isNull(), F.col(f"c{at}")).otherwise(kept)
    rest = [(new if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    return both.select(*rest, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """Result of op9: doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left)."""
    left = drop_templates(docs)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
