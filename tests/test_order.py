"""Ranks, running totals and quantiles against NumPy, with ties over the bounds of ranges, nulls and hot values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import metrics, order
from tapeline.sinks import stored

SCHEMA = "model string, x double, y double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", 0.25, float(rng.random() < 0.4)) for _ in range(3000)]  # a third of all rows are one value
    out += [("hot", rng.random(), float(rng.random() < 0.5)) for _ in range(2500)]
    out += [("few", round(rng.random(), 1), float(rng.random() < 0.5)) for _ in range(1500)]
    out += [("one", 0.7, 1.0), (None, 0.2, 0.0), (None, 0.9, 1.0), (None, 0.4, 1.0), ("nulls", None, 1.0), ("nulls", None, None), ("few", None, 0.0)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


def by_model(rows):
    out = {}
    for m, x, y in rows:
        if x is not None and y is not None:
            out.setdefault(m, []).append((x, y))
    return {m: np.array(v) for m, v in out.items()}


def test_ranks_are_places_in_the_group(df, rows):
    with stored.Steps():
        one = df.where("x is not null").withColumn("id", F.monotonically_increasing_id())
        found = order.ranked(one, ["model"], ["x", "id"]).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.model, []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r.x, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert len(found) == sum(x is not None for _, x, _ in rows)


def test_ranks_without_groups(spark):
    with stored.Steps():
        assert [r["rank"] for r in order.ranked(spark.range(1000).repartition(5), [], ["id"]).orderBy("id").collect()] == list(range(1, 1001))
        assert order.ranked(spark.range(0), [], ["id"]).count() == 0


@pytest.mark.parametrize("accuracy", (2000, 4))
def test_quantiles_equal_numpy(df, rows, accuracy):
    """With a coarse sketch the bounds are wide; the result is the same."""
    at = {"low": 0.0, "p01": 0.01, "p25": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}
    with stored.Steps():
        found = {r.model: r for r in order.quantiles(df, ["model"], "x", at, accuracy=accuracy).collect()}
    values = {}
    for m, x, _ in rows:
        if x is not None:
            values.setdefault(m, []).append(x)
    assert found.keys() == values.keys()
    for m, own in values.items():
        assert found[m].n == len(own)
        for name, q in at.items():
            assert found[m][name] == pytest.approx(np.quantile(own, q), abs=1e-12), (m, name)


def test_missed_bounds_go_through_whole(df, rows, monkeypatch):
    """A sketch that names wrong bounds costs a second pass, not the result."""
    wrong = lambda c, qs, a: F.array(*[F.lit(2.0)] * 2)
    monkeypatch.setattr(order.F, "percentile_approx", wrong)
    with stored.Steps():
        found = {r.model: r.mid for r in order.quantiles(df, ["model"], "x", {"mid": 0.5}).collect()}
    for m in ("hot", "few"):
        assert found[m] == pytest.approx(np.median([x for k, x, _ in rows if k == m and x is not None]), abs=1e-12)


def test_no_window_or_percentile_over_the_group(df):
    with stored.Steps():
        for out in (metrics.binary_metrics(df, ["model"], "x", "y"), metrics.probability_summary(df, ["model"], "x")):
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "percentile" not in plan
            assert all("_range" in x for x in plan.splitlines() if "windowspecdefinition" in x)


def test_auc_by_average_ranks(df, rows):
    with stored.Steps():
        found = {r.model: r for r in metrics.binary_metrics(df, ["model"], "x", "y").collect()}
    for m, own in by_model(rows).items():
        p, y = own[:, 0], own[:, 1]
        n1, n0 = int(y.sum()), int((1 - y).sum())
        wins = (p[y == 1][:, None] > p[y == 0][None]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0][None]).sum()
        assert found[m].n == len(own)
        assert found[m].auc == (pytest.approx(wins / (n1 * n0)) if n1 * n0 else None)
        assert found[m].brier == pytest.approx(((p - y) ** 2).mean())
        assert found[m].accuracy == pytest.approx(((p > 0.5) == y).mean())


def test_steps_go_with_their_owner_only(spark):
    with stored.Steps():
        outer = stored.stored(spark.range(5))
        with stored.Steps():
            inner = stored.stored(spark.range(7))
            assert inner.count() == 7
        assert outer.count() == 5
        with pytest.raises(Exception, match="(?i)file"):
            inner.count()


@pytest.mark.parametrize("accuracy", (2000, 4))
def test_columns_described_where_they_lie(spark, accuracy, monkeypatch):
    """All columns at once, each row once: equal to NumPy with nulls, ties, one value only and no value; a sketch that misses is made good."""
    rng = random.Random(5)
    rows = [(rng.choice((None, rng.random(), 0.25)), float(k % 3), 0.1 if k % 4 else None, None) for k in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    explodes = []
    plain = order.quantiles
    monkeypatch.setattr(order, "quantiles", lambda *a, **k: explodes.append(1) or plain(*a, **k))
    with stored.Steps():
        found = {r.f: r for r in order.described(df, [F.col(c) for c in "abcd"], 0.5, accuracy=accuracy).collect()}
    assert len(found) == 4 and (accuracy < 2000 or not explodes)
    for i in range(4):
        own = np.array([r[i] for r in rows if r[i] is not None])
        assert found[i].n == len(own)
        if len(own):
            assert found[i].quantile == np.median(own) and abs(found[i]["mean"] - own.mean()) < 1e-12 and abs(found[i].deviation - own.std()) < 1e-12
        else:
            assert found[i].quantile is None
