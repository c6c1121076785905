"""The logistic baseline against a Newton fit, stored models, members that are trained once, experiments at once."""

import datetime as dt
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.config import EngineConfig, Experiment
from tapeline.models.logistic import FEATURES, LogisticBaseline, LogisticBaselineModel, medians
from tapeline.models.members import Member, Store
from tapeline.models.pixels import bands, pixel_logistic
from tapeline.plans import training
from tapeline.plans.concurrent import at_once

COLUMNS = ["ret_1d", "reversal_5d", "vol_20d", "constant", "never"]


def made(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 0.02), rng.gauss(0, 1) if rng.random() > 0.2 else None, round(rng.random(), 1), 3.0, None]
        y = float(rng.random() < 1 / (1 + np.exp(-(40 * x[0] + 0.8 * (x[1] or 0) - x[2]))))
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i // 6), f"{i % 6:06d}", *x, y if i % 50 else None))
    return rows


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(made(), "date date, code string, " + ", ".join(f"{c} double" for c in COLUMNS) + ", label double").repartition(5).cache()


def newton(rows, c=1.0):
    """The same model by NumPy: median filling, population scaling, an unpenalised intercept."""
    own = [r for r in rows if r[-1] is not None]
    x = np.array([[np.nan if v is None else v for v in r[2:-1]] for r in own], float)
    y = np.array([r[-1] for r in own])
    middle = np.array([np.nanmedian(col) if np.isfinite(col).any() else 0.0 for col in x.T])
    x = np.where(np.isnan(x), middle, x)
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    z = np.column_stack([(x - mean) / sd, np.ones(len(y))])
    penalty = np.diag([1 / c] * (z.shape[1] - 1) + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return middle, mean, sd, w


def test_fit_equals_newton(train):
    middle, mean, sd, w = newton(made())
    model = LogisticBaseline(features=COLUMNS).fit(train)
    assert np.allclose(model.getOrDefault("middle"), middle, atol=1e-12)
    assert np.allclose(model.getOrDefault("mean"), mean, atol=1e-9) and np.allclose(model.getOrDefault("deviation"), sd, atol=1e-9)
    found = {(r.date, r.code): r.pred_prob for r in model.transform(train).collect()}
    for r in made():
        z = [((m if v is None else v) - a) / s for v, m, a, s in zip(r[2:-1], middle, mean, sd, strict=True)]
        assert found[r[0], r[1]] == pytest.approx(1 / (1 + np.exp(-(np.dot(z, w[:-1]) + w[-1]))), abs=1e-4)


def test_medians_of_hot_values(spark):
    df = spark.createDataFrame([(1.0, float(i % 3), None) for i in range(600)] + [(float("nan"), 9.0, None)], "a double, b double, c double")
    assert medians(df, ["a", "b", "c"]) == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_empty_training_table(train):
    with pytest.raises(ValueError, match="no row"):
        LogisticBaseline(features=COLUMNS).fit(train.where("label > 5"))


def test_model_is_written_and_read(train, tmp_path):
    estimator = LogisticBaseline(features=COLUMNS, inverse_penalty=0.5)
    estimator.save(f"{tmp_path}/estimator")
    again = LogisticBaseline.load(f"{tmp_path}/estimator")
    assert again.getOrDefault("features") == COLUMNS and again.getOrDefault("inverse_penalty") == 0.5
    model = estimator.fit(train)
    model.save(f"{tmp_path}/model")
    with pytest.raises(Exception, match="(?i)exist"):
        model.save(f"{tmp_path}/model")
    model.write().overwrite().save(f"{tmp_path}/model")
    other = LogisticBaselineModel.load(f"{tmp_path}/model")
    assert other.uid == model.uid
    both = other.transform(train).select("date", "code", F.col("pred_prob").alias("p")).join(model.transform(train), ["date", "code"])
    assert both.where("p <> pred_prob or p is null").count() == 0


CFG = EngineConfig(start=dt.date(2020, 1, 1), end=dt.date(2021, 12, 31), train_end=dt.date(2020, 3, 31), valid_start=dt.date(2020, 4, 1), valid_end=dt.date(2020, 4, 30), test_start=dt.date(2020, 5, 1), folds=2, purge_days=3, embargo={5: 5}, experiments=(Experiment("I5R5", 5, 5), Experiment("I20R5", 20, 5)))


def stored_features(spark, path):
    rng = random.Random(8)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), f"{c:06d}", "x", 1, 5e7, 1e9, 0, 0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.05)) for d in range(150) for c in range(8)]
    df = spark.createDataFrame(rows, "date date, code string, industry string, is_tradable int, amount double, float_mktcap double, is_low_volume_limit_up int, is_low_volume_limit_down int, reversal_5d double, vol_20d double, future_ret_5d double")
    df = df.withColumns({"label_5d": (F.col("future_ret_5d") > 0).cast("double"), "ma5_adj": F.lit(1.0), "ma20_adj": F.when(F.col("date") > "2020-01-20", 1.0)})
    df.write.parquet(f"{path}/features_by_year")


def test_logistic_stage(spark, tmp_path):
    stored_features(spark, tmp_path)
    rows = training.train_logistic(spark, CFG, str(tmp_path))
    assert [(r["experiment_name"], r["split"]) for r in rows] == [("I20R5", "test"), ("I20R5", "valid"), ("I5R5", "test"), ("I5R5", "valid")]
    assert rows[3]["train_rows"] - rows[0]["train_rows"] == 20 * 8  # the average over 20 days isn't known before
    pred = spark.read.parquet(f"{tmp_path}/predictions/pred_i5r5_logistic.parquet")
    assert pred.columns[:10] == list(training.CARRIED) and pred.count() == rows[2]["n"] and {r.model_name for r in pred.select("model_name").distinct().collect()} == {"LogisticRaw"}
    model = LogisticBaselineModel.load(f"{tmp_path}/models/i5r5_logistic")
    assert model.getOrDefault("features") == [c for c in FEATURES if c in ("reversal_5d", "vol_20d")]


def test_empty_split_is_an_error(spark, tmp_path):
    stored_features(spark, tmp_path)
    late = EngineConfig(**{**CFG.__dict__, "test_start": dt.date(2021, 6, 1)})
    with pytest.raises(RuntimeError, match="I5R5.*empty.*'test': 0"):
        training.train_logistic(spark, late, str(tmp_path), experiments="I5R5")


def test_members_are_trained_once(spark, tmp_path):
    stored_features(spark, tmp_path)
    e = CFG.experiments[0]
    first = training.train_members(spark, CFG, str(tmp_path), e, seeds=(1, 2))
    assert [(m["fold"], m["seed"]) for m in first] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "members").rglob("*") if p.is_file()}
    assert training.train_members(spark, CFG, str(tmp_path), e, seeds=(1, 2)) == first
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "members").rglob("*") if p.is_file()} == files
    # a member without its manifest, as a run that was stopped leaves it, and one whose manifest is cut off
    at = "loss=bce/experiment=I5R5/fold=2"
    (tmp_path / "members/done" / at / "seed=1/manifest.json").unlink()
    (tmp_path / "members/predictions" / at / "seed=1/part-half.parquet").write_bytes(b"half")
    (tmp_path / "members/done" / at / "seed=2/manifest.json").write_text('{"loss": "bce"')
    again = training.train_members(spark, CFG, str(tmp_path), e, seeds=(1, 2))
    assert [{k: v for k, v in m.items() if k != "valid_auc"} for m in again] == [{k: v for k, v in m.items() if k != "valid_auc"} for m in first]
    changed = {p.parent.name + p.parent.parent.name for p in (tmp_path / "members/predictions").rglob("part-*") if files.get(p) != p.stat().st_mtime_ns}
    assert changed == {"seed=1fold=2", "seed=2fold=2"}
    assert not list((tmp_path / "members").rglob("part-half*"))
    pred = Store(spark, f"{tmp_path}/members").predictions()
    assert pred.groupBy("fold", "seed").count().count() == 4 and pred.select("date", "code").distinct().count() * 4 == pred.count()
    from tapeline.plans import pipeline

    pipeline.aggregate(spark, f"{tmp_path}/members/predictions", "bce", "I5R5", str(tmp_path), folds=2, seeds=2)
    assert spark.read.parquet(f"{tmp_path}/predictions/I5R5_bce").where("ensemble_member_count = 4").count() == pred.count() // 4


def test_bags_don_t_depend_on_partitions(train):
    one, two = (set(map(tuple, training.bagged(df, 7).select("date", "code").collect())) for df in (train, train.repartition(1)))
    assert one == two and 0.7 < len(one) / train.count() < 0.9 and one != set(map(tuple, training.bagged(train, 8).select("date", "code").collect()))


def test_manifest_of_another_member(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.manifest(Member("bce", "I5R5", 1, 1)) is None


def test_tasks_overlap_in_time(spark):
    meet = threading.Barrier(2, timeout=30)

    def task(n):
        meet.wait()  # ends only if both run
        return spark.range(n).count()

    assert at_once(spark, {"a": lambda: task(5), "b": lambda: task(7)}, 2) == {"a": 5, "b": 7}
    assert at_once(spark, {}, 2) == {}


def test_first_failure_cancels_the_others(spark):
    started = threading.Event()

    def slow():
        started.set()
        return spark.range(8, numPartitions=8).select(F.expr("java_method('java.lang.Thread', 'sleep', 60000L)")).collect()

    def wrong():
        started.wait(30)
        time.sleep(1)
        raise ValueError("no such column")

    began = time.time()
    with pytest.raises(RuntimeError, match="wrong failed: no such column"):
        at_once(spark, {"slow": slow, "wrong": wrong, "never": lambda: pytest.fail("begun")}, 2)
    assert time.time() - began < 40
    assert spark.range(3).count() == 3


def test_pixel_bands(spark):
    height, width = 32, 15
    image = bytearray(height * width)
    image[: 4 * width] = b"\xff" * (4 * width)
    df = spark.createDataFrame([(bytes(image), 1.0), (bytes(height * width), 0.0)] * 10, "image binary, label double")
    first = bands(df, 5).first()
    assert first.band_0 == 1.0 and first.band_1 == 0.0
    found = pixel_logistic().fit(bands(df, 5)).transform(bands(df, 5)).select("label", "pred_prob").collect()
    assert all((r.pred_prob > 0.5) == (r.label == 1.0) for r in found)


def test_moments_of_filled_columns(spark):
    """Mean and deviation after filling follow from those before it; a constant column with gaps has a deviation of exactly 0."""
    from tapeline.models.logistic import filled_moments

    rows = [(0.1 * (k * k % 17) if k % 5 else None, 0.1 if k % 3 else None, None) for k in range(700)]
    found, n = filled_moments(spark.createDataFrame(rows, "a double, b double, c double").repartition(5), ["a", "b", "c"])
    middle = np.median([r[0] for r in rows if r[0] is not None])
    filled = np.array([middle if r[0] is None else r[0] for r in rows])
    assert n == 700 and found["a"][0] == middle and abs(found["a"][1] - filled.mean()) < 1e-12 and abs(found["a"][2] - filled.std()) < 1e-12
    assert found["b"] == (0.1, 0.1, 0.0) and found["c"] == (0.0, 0.0, 0.0)
