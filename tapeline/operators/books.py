"""Days of the three books by array operations: positions of some codes at a time are exploded, weighed and added up in numpy.

What it gives is ``turned_days(held_days(...))`` of ``portfolio``, which states it row by row. A task holds the positions of some codes
only, whatever the number of codes, and yields their sums by book and day, which Spark adds up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.exprs import safe_div

# workers may not find this package, so functions go to them with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOOKS = ("ideal", "constrained", "actual")
#: Positions (of groups and deciles) that are exploded at once, as far as codes allow, and those of a task.
CHUNK, TASK = 1 << 16, 1 << 20
_FLOATS = [f"{b}_{c}" for b in BOOKS for c in ("sum", "valid", "missing")] + ["share", "_opening", "end_turnover", "_leaving"]
_COUNTS = [f"{b}_{c}" for b in BOOKS for c in ("unknown", "holdings")] + ["blocked", "due_unknown", "not_opened", "not_known"]


def _sizes(rows: list) -> dict:
    """Cohorts (g, decile, signal_pos, n_all, n_open, late) as arrays in order of their keys, and their late exits one after the other."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (r.g, r.decile, r.signal_pos))
    late = [(i, x["gone"], x["_same"]) for i, r in enumerate(rows) for x in sorted(r.late, key=lambda x: x["gone"])]
    of = np.array([x[0] for x in late], np.int64)
    out = {k: np.array([r[k] for r in rows], np.int64) for k in ("g", "decile", "signal_pos", "n_all", "n_open")}
    return out | {"late": np.array([x[1] for x in late], np.int64), "before": np.concatenate([[0], np.cumsum([x[2] for x in late], dtype=np.int64)]).astype(np.int64), "of": of, "end": np.searchsorted(of, np.arange(len(rows)), side="right")}


def _chunks(batches: Iterator, least: int) -> Iterator:
    """Tables of whole codes, about ``least`` positions each, of batches in order of code."""
    import numpy as np
    import pyarrow as pa

    def weight(b):
        return len(b.column("tags").flatten())

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += weight(batch)
        if n < least:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        code = table.column("code").combine_chunks().dictionary_encode().indices.to_numpy()
        cut = int(np.argmax(code == code[-1]))
        if cut:
            yield table.slice(0, cut)
        waiting = table.slice(cut).to_batches()
        n = sum(map(weight, waiting)) if cut else 0  # a code that goes on is looked at again after as many more
    if waiting:
        yield pa.Table.from_batches(waiting)


def _added(table, sizes: dict, overlapping: bool) -> dict:
    """Sums by (g, decile, pos) over the positions of a table of whole codes."""
    import numpy as np

    table = table.combine_chunks()
    code = table.column("code").combine_chunks().dictionary_encode().indices.to_numpy()
    tags = table.column("tags").combine_chunks()
    is_pos = ~np.asarray(tags.is_null())
    nums = {c: np.asarray(table.column(c).combine_chunks().fill_null(False if c in ("open", "unknown") else 0)) for c in ("signal_pos", "start", "end", "open", "unknown", "gone", "last", "horizon", "ret", "o2c", "susp")}
    null = {c: np.asarray(table.column(c).combine_chunks().is_null()) for c in ("ret", "o2c")}
    if not is_pos.any():
        return {}
    # the codes' days, with a last one for days that aren't there
    ret, o2c, susp = (np.append(nums[c][~is_pos], 0) for c in ("ret", "o2c", "susp"))
    no_ret, no_o2c = (np.append(null[c][~is_pos], True) for c in ("ret", "o2c"))
    p = {c: nums[c][is_pos] for c in ("signal_pos", "start", "end", "open", "unknown", "gone", "last", "horizon")}
    start, end, gone, opened = p["start"], p["end"], p["gone"], p["open"].astype(bool)
    until = np.where(opened, np.maximum(end, np.minimum(gone, p["last"])), end)
    span = int(max(until.max(), nums["start"].max())) + 2
    key = code[~is_pos].astype(np.int64) * span + nums["start"][~is_pos]
    order = np.argsort(key, kind="stable")
    key = key[order]

    def exploded(n):
        """For ``n`` rows of each: whose it is and which of these it is."""
        whose = np.repeat(np.arange(len(n)), n)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)

    days = until - start + 1
    whose, k = exploded(days)
    wanted = code[is_pos][whose].astype(np.int64) * span + start[whose] + k
    at = np.searchsorted(key, wanted)
    there = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == wanted) if len(key) else np.zeros(len(wanted), bool)
    day_row = np.where(there, order[np.minimum(at, len(key) - 1)] if len(key) else 0, len(ret) - 1)
    first = np.cumsum(days) - days

    flat = tags.flatten()
    g, decile = (np.asarray(flat.field(c)).astype(np.int64) for c in ("g", "decile"))
    counts = np.asarray(tags.value_lengths().fill_null(0))[is_pos]
    tag_pos, _ = exploded(counts)
    books, book = np.unique(np.stack([g, decile]), axis=1, return_inverse=True)
    book = book.reshape(-1)
    # a cohort's place among the sizes
    names = {(int(a), int(b)): i for i, (a, b) in enumerate(books.T)}
    own = np.array([names.get((a, b), -1) for a, b in zip(sizes["g"].tolist(), sizes["decile"].tolist())], np.int64)
    far = int(sizes["signal_pos"].max()) + 2
    cohort_key = np.where(own < 0, -1, own * far + sizes["signal_pos"])
    by = np.argsort(cohort_key, kind="stable")
    cohort = by[np.searchsorted(cohort_key[by], book * far + p["signal_pos"][tag_pos])]

    tag, k = exploded(days[tag_pos])
    pos = tag_pos[tag]
    day, row, c = start[pos] + k, day_row[first[pos] + k], cohort[tag]
    del k
    n_all, n_open = sizes["n_all"][c], sizes["n_open"][c]
    slot = 1 / p["horizon"][pos] if overlapping else np.ones(len(pos))
    is_open = opened[pos]
    planned, due, opens = day <= end[pos], day >= end[pos], day == start[pos]
    on = {"ideal": planned, "constrained": is_open & planned, "actual": is_open & (day <= gone[pos])}

    bound = 1 << 40
    late = sizes["of"] * bound + np.minimum(sizes["late"], bound - 1)

    def later(rows, k):
        """Positions of these rows' cohorts that leave later than ``k``."""
        return sizes["before"][sizes["end"][c[rows]]] - sizes["before"][np.searchsorted(late, c[rows] * bound + k, side="right")]

    alive, kept = n_open.copy(), n_open.copy()
    beyond = np.flatnonzero(~planned)
    alive[beyond] = later(beyond, day[beyond] - 1)
    if overlapping:
        ends = np.flatnonzero(due)
        kept[ends] = later(ends, day[ends])
    stays = on["actual"] & (gone[pos] > day)
    with np.errstate(all="ignore"):
        share = np.where(on["actual"], 1 / alive, 0.0)
        w = {"ideal": slot / n_all, "constrained": slot / n_open, "actual": slot / (alive if overlapping else n_open)}
        w = {b: np.where(on[b], w[b], 0.0) for b in BOOKS}
        w_end = np.where(stays, slot / kept, 0.0)

    # what is held: a row for each book, code and day, a code's days one after the other
    held = (book[tag] * (int(code.max()) + 1) + code[is_pos][pos]) * span + day
    order = np.argsort(held, kind="stable")
    held = held[order]
    begin = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    total = lambda v: np.add.reduceat(v[order], begin)
    number = lambda v: np.add.reduceat(v[order].astype(np.int64), begin)
    held, one = held[begin], order[begin]
    row = row[one]
    q_ret, q_o2c, q_no_ret, q_no_o2c, q_susp = ret[row], o2c[row], no_ret[row], no_o2c[row], susp[row] == 1
    out = {}
    for b in BOOKS:
        weight, has, new = total(w[b]), number(on[b]) > 0, number(on[b] & opens) > 0
        missing = np.where(new, q_no_o2c, q_no_ret)
        r = np.where(missing, 0.0, np.where(new, q_o2c, q_ret))
        missing = has & missing & ~q_susp
        known = has & ~missing
        out |= {f"{b}_sum": np.where(known, weight * r, 0.0), f"{b}_valid": np.where(known, weight, 0.0), f"{b}_missing": np.where(missing, weight, 0.0), f"{b}_unknown": missing, f"{b}_holdings": has}
        if b == "actual":
            now, then = weight, total(w_end)
    out["share"] = total(share)
    due_now = on["actual"] & due
    out["blocked"] = number(due & stays)
    out["due_unknown"] = np.where(q_no_o2c, number(due_now & opens), 0) + np.where(q_no_ret, number(due_now & ~opens), 0)
    out["not_opened"], out["not_known"] = number(opens & ~is_open), number(opens & p["unknown"].astype(bool)[pos])
    follows = np.append(False, held[1:] == held[:-1] + 1)  # the same book and code on the day before
    before = np.where(follows, np.append(0.0, then[:-1]), 0.0)
    out |= {"_opening": np.abs(now - before), "end_turnover": np.abs(then - now), "_leaving": np.where(np.append(follows[1:], False), 0.0, np.abs(then))}

    cell = book[tag[one]] * span + held % span
    cells, cell = np.unique(cell, return_inverse=True)
    summed = {k: np.bincount(cell, weights=v, minlength=len(cells)) for k, v in out.items()}
    return {"g": books[0][cells // span], "decile": books[1][cells // span], "pos": cells % span} | {k: v if k in _FLOATS else np.rint(v).astype(np.int64) for k, v in summed.items()}


def summed_days(asked: DataFrame, days: DataFrame, sizes: list, overlapping: bool) -> DataFrame:
    """A row for each book and day: sums over positions ``asked`` (code, signal_pos, horizon, start, end, last, tags, open, unknown, gone), whose daily rows are ``days``.

    ``sizes`` are the rows of ``cohorts``, a few numbers for each cohort, which every task looks up.
    """
    spark = asked.sparkSession
    known = spark.sparkContext.broadcast(_sizes(sizes)) if sizes else None
    schema = ", ".join([f"{c} long" for c in ("g", "decile", "pos")] + [f"{c} double" for c in _FLOATS] + [f"{c} long" for c in _COUNTS])
    names = ["g", "decile", "pos", *_FLOATS, *_COUNTS]

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table in _chunks(batches, CHUNK):
            if known and (found := _added(table, known.value, overlapping)):
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names], names=names)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n_all for r in sizes) // TASK))
    long = lambda *columns: [F.col(c).cast("long").alias(c) for c in columns]
    rows = asked.select("code", *long("signal_pos", "horizon", "start", "end", "last", "gone"), "open", "unknown", "tags")
    daily = days.select("code", F.col("pos").cast("long").alias("start"), *[F.col(c).cast("double").alias(c) for c in ("ret", "o2c")], F.col("susp").cast("int").alias("susp"))
    df = rows.unionByName(daily, allowMissingColumns=True).repartition(n, "code").sortWithinPartitions("code").mapInArrow(added, schema)
    df = df.groupBy("g", "decile", "pos").agg(*[F.sum(c).alias(c) for c in (*_FLOATS, *_COUNTS)])
    of = [x for b in BOOKS for x in (safe_div(F.col(f"{b}_sum"), F.when(F.col(f"{b}_valid") > 0, F.col(f"{b}_valid"))).alias(f"{b}_return"), f"{b}_valid", f"{b}_missing", f"{b}_unknown", F.nullif(f"{b}_holdings", F.lit(0)).alias(f"{b}_holdings"))]
    more = (("share", "actual_cohorts"), ("blocked", "actual_blocked"), ("due_unknown", "actual_due_unknown"), ("not_opened", "ideal_not_opened"), ("not_known", "ideal_not_known"))
    return df.select("g", "decile", "pos", *of, *[(F.round(k).cast("long") if k == "share" else F.col(k)).alias(v) for k, v in more], "_opening", "end_turnover", "_leaving")
