"""Semantics of the panel engine on small fixtures."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeline.config import EngineConfig, image_shape
from tapeline.functions import exprs
from tapeline.operators import cross_section, features, images, metrics, panel, performance, portfolio, qa, targets

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def one(spark, **exprs_by_name):
    return spark.range(1).select(*[v.alias(k) for k, v in exprs_by_name.items()]).first()


def test_cleaning(spark):
    df = spark.createDataFrame([("sz.1", "1,234", "是"), ("000001", "--", "N"), ("1234567", "nan", "Y"), ("x", "2.5", None), (None, "", "否"), ("7", "abc", "1")], "code string, num string, flag string")
    got = df.select(exprs.zfill_code(F.col("code")), exprs.to_number(F.col("num")), exprs.to_flag(F.col("flag")), exprs.code_bucket(F.coalesce("code", F.lit("")))).collect()
    assert [tuple(r) for r in got] == [("000001", 1234.0, 1, 1), ("000001", None, 0, 1), ("1234567", None, 1, 1234567 % 128), (None, 2.5, 0, 0), (None, None, 0, 0), ("000007", None, 1, 7)]
    r = one(spark, a=exprs.safe_div(F.lit(1.0), F.lit(0.0)), b=exprs.to_day(F.lit("2020-02-30")), c=exprs.to_day(F.lit("20200229")), d=exprs.clipped_sigmoid(F.lit(1e9)), e=exprs.model_family(F.lit("My_CNN_v2")))
    assert r.a is None and r.b is None and r.c == dt.date(2020, 2, 29) and r.d == 1 / (1 + math.exp(-30)) and r.e == "CNN"


def test_limit_threshold(spark):
    cfg = EngineConfig()
    rows = [("688001", D(0), 0), ("300001", dt.date(2020, 8, 23), 0), ("300001", dt.date(2020, 8, 24), 0), ("688001", D(0), 1), ("600000", D(0), 0)]
    df = spark.createDataFrame(rows, "code string, date date, is_st int")
    assert [r[0] for r in df.select(exprs.limit_threshold(F.col("code"), F.col("date"), F.col("is_st"), cfg)).collect()] == [19.8, 9.8, 19.8, 4.8, 9.8]


def test_outer_merge(spark):
    raw = spark.createDataFrame([(D(0), "000001", 1.0, 2.0, 0.5, 1.5, 100.0, 5.0, 0), (D(1), "000001", 1.0, 2.0, 0.5, 1.5, 0.0, 5.0, 0), (D(2), "000001", None, 2.0, 0.5, 1.5, 10.0, None, 1)], "date date, code string, open_raw double, high_raw double, low_raw double, close_raw double, volume double, amount double, is_st int")
    adj = spark.createDataFrame([(D(0), "000001", 10.0, 20.0, 5.0, None), (D(3), "000001", 1.0, 1.0, 1.0, 1.0)], "date date, code string, open_adj double, high_adj double, low_adj double, close_adj double")
    got = {r.date: r for r in panel.build_panel(raw, adj).collect()}
    assert got[D(0)].used_raw_as_adj == 1 and got[D(0)].close_adj == 1.5 and got[D(0)].open_adj == 10.0 and got[D(0)].is_suspended == 0
    assert got[D(1)].is_suspended == 1 and got[D(2)].is_suspended == 1 and got[D(2)].is_tradable_basic == 0
    assert got[D(3)].used_raw_as_adj == 0 and got[D(3)].is_suspended == 1
    only = panel.build_panel(None, adj).where(F.col("date") == F.lit(D(3))).first()
    assert only.is_suspended == 0 and only.is_tradable_basic == 1
    with pytest.raises(ValueError):
        panel.merge_prices(raw.union(raw), adj, check=True)
    assert panel.to_storage(panel.build_panel(raw, adj)).dtypes == [(f.name, f.dataType.simpleString()) for f in panel.schema.panel().fields]


def price_rows(n, closes=None):
    return [(D(i), "000001", float(i + 1), float(i + 2), float(i), (closes or {}).get(i, float(i + 1)), 100.0 if i else None, 1e6, 0, 0, 1, None, 0.0) for i in range(n)]


PRICES = "date date, code string, open_adj double, high_adj double, low_adj double, close_adj double, volume double, amount double, is_st int, is_suspended int, is_tradable_basic int, days_since_list double, pct_chg double"


def test_features_gate_full_windows(spark):
    cfg = EngineConfig(min_amount=1.0)
    f = features.build_features(spark.createDataFrame(price_rows(30, {3: None}), PRICES), cfg).orderBy("date").collect()
    assert f[4].ret_1d == 5 / 3 - 1 and f[3].ret_1d == 0.0  # the gap is padded
    assert f[7].ma5_adj is None and f[8].ma5_adj == 7.0
    assert f[0].future_ret_5d == 6 / 2 - 1 and f[0].label_5d == 1.0 and f[27].label_5d is None
    assert f[20].volume_mean_20d_prev is None and f[21].volume_mean_20d_prev == 100.0
    assert f[3].open_to_close_ret_1d is None and f[5].is_tradable == 1
    plain = features.returns(spark.createDataFrame(price_rows(6, {3: None}), PRICES), EngineConfig(pad_missing_returns=False)).orderBy("date").collect()
    assert plain[3].ret_1d is None and plain[4].ret_1d is None


def predictions(spark, n, scores, rets, date=D(0), model="m", caps=None):
    return spark.createDataFrame([(date, f"{i:06d}", scores[i], rets[i], None if caps is None else caps[i], 5, "E", model, "all") for i in range(n)], "date date, code string, score double, future_ret double, float_mktcap double, horizon int, experiment_name string, model_name string, universe_group string")


@pytest.mark.parametrize("n", [9, 10, 11, 91, 123])
def test_deciles_equal_quantile_edges(spark, n):
    import pandas as pd

    got = {r.code: r.decile for r in cross_section.deciles(predictions(spark, n, [float(i % 7) for i in range(n)], [0.0] * n)).collect()}
    if n < 10:
        assert set(got.values()) == {None}
    else:
        order = sorted(range(n), key=lambda i: (i % 7, i))
        cut = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1
        assert [got[f"{i:06d}"] for i in order] == list(cut)


def test_information_coefficient_needs_variation(spark):
    flat = cross_section.ic_by_period(predictions(spark, 5, [1.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0])).first()
    up = cross_section.ic_by_period(predictions(spark, 4, [1.0, 2.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0])).first()
    assert flat.ic is None and flat.rankic is None and abs(up.rankic - 0.9486832980505138) < 1e-12


def test_universe_is_a_strict_third(spark):
    df = predictions(spark, 6, [0.0] * 6, [0.0] * 6, caps=[1.0, 2.0, 3.0, 4.0, 5.0, None]).drop("universe_group")
    got = sorted((r.code[-1], r.universe_group) for r in cross_section.universes(df).collect() if r.universe_group != "all")
    assert got == [("0", "small_mid_cap"), ("1", "small_mid_cap"), ("2", "small_mid_cap"), ("3", "large_cap"), ("4", "large_cap")]


def test_folds_and_purge(spark):
    days = [d for d in (dt.date(2009, 1, 1) + dt.timedelta(days=i) for i in range(200)) if d.weekday() < 5]
    cal = targets.calendar(spark.createDataFrame([(d,) for d in days[:105]], "date date"))
    r = sorted(targets.fold_ranges(cal, 5).collect())
    assert [x.n_dates for x in r] == [21] * 5 and r[0].fold_start == days[0] and r[-1].fold_end == days[104]
    sample = spark.createDataFrame([(d, c) for d in days[:120] for c in ("000001", "000002")], "date date, code string")
    cfg = EngineConfig(folds=3, test_start=dt.date(2030, 1, 1))
    got = {(x.fold, x.split): x.n for x in targets.purged_folds(sample, targets.calendar(sample), cfg).groupBy("fold", "split").agg(F.count("*").alias("n")).collect()}
    assert got[1, "valid"] == 80 and got[1, None] == 80 and got[1, "train"] == 80
    assert {r.date for r in targets.edge_dates(sample, 1).collect()} == {days[0]}


def test_winsor_target(spark):
    df = spark.createDataFrame([(D(0), x) for x in (1.0, 2.0, 3.0, 100.0)] + [(D(1), x) for x in (-2.0, 0.0, 2.0, 4.0)] + [(D(2), 1.0)], "date date, future_ret double")
    got = targets.winsor_target(df).groupBy("date").agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("s")).orderBy("date").collect()
    assert all(abs(r.m) < 1e-6 and abs(r.s - 1) < 1e-6 for r in got[:2]) and got[2].m == 0.0


def test_metrics(spark):
    df = spark.createDataFrame([("a", 0.1, 0.0), ("a", 0.4, 0.0), ("a", 0.4, 1.0), ("a", 0.9, 1.0), ("b", 0.3, 1.0)], "k string, probability double, label double")
    got = {r.k: r for r in metrics.binary_metrics(df, ["k"]).collect()}
    assert got["a"].auc == 0.875 and got["a"].accuracy == 0.75 and got["b"].auc is None
    o = metrics.objective_metrics(spark.createDataFrame([(D(0), -1.0, 0.0, -1.0), (D(0), 0.0, 0.0, -0.5), (D(0), 0.5, 1.0, 0.5), (D(0), 2.0, 1.0, 1.0)], "date date, score double, label double, target double"), "score", "label", "target").first()
    assert all(math.isfinite(x) for x in o)


def test_image_of_flat_and_falling_days(spark):
    cfg = EngineConfig()
    lit = spark.createDataFrame([(D(0), "000001", 0.0, 10.0, 100.0, [Row(o=10.0, h=10.0, l=0.0, c=0.0, a=100.0, m=10.0), Row(o=5.0, h=5.0, l=5.0, c=5.0, a=0.0, m=0.0)])], "date date, code string, p_min double, p_max double, amount_max double, days array<struct<o:double,h:double,l:double,c:double,a:double,m:double>>")
    px = {(p.x, p.y) for p in images.pixels(lit, 2, cfg).first().pixels}
    height, width, price, volume = image_shape(2)
    assert {(1, y) for y in range(price)} <= px and (0, 0) in px and (2, price - 1) in px
    assert (3, height - 1) in px and (3, height - 2) not in px and (0, height - volume) in px
    img = images.dense(images.pixels(lit, 2, cfg), 2, cfg).first().image
    assert len(img) == height * width and {i for i, v in enumerate(img) if v == 255} == {y * width + x for x, y in px} and set(img) == {0, 255}
    counts = qa.images(spark.createDataFrame([(D(0), "1", bytearray(img), 1.0, None), (D(0), "1", bytearray(b"\x01"), None, None)], "date date, code string, image binary, label_5d double, future_ret_5d double"), height, width, (5,)).first()
    assert (counts.n_wrong_size, counts.n_not_binary, counts.n_duplicate_keys, counts.n_unpaired_labels) == (1, 1, 1, 1)


def world(rng, codes, days):
    """Daily rows with absences, null returns, suspensions and blocked moves."""
    rows = {}
    for p in range(days):
        for c in range(codes):
            if rng.random() > 0.08:
                rows[p, c] = (None if rng.random() < 0.06 else rng.uniform(-0.1, 0.1), None if rng.random() < 0.06 else rng.uniform(-0.1, 0.1), 0.0 if rng.random() < 0.05 else 9.0, int(rng.random() < 0.1), int(rng.random() < 0.12), int(rng.random() < 0.15))
    return rows


def simulate(rows, signals, horizon, last):
    """The overlapping book of one decile day by day."""
    free = lambda p, c, r: (p, c) in rows and not rows[p, c][3] and not rows[p, c][5] and rows[p, c][r] is not None
    buy = lambda p, c: (p, c) in rows and not rows[p, c][3] and not rows[p, c][4] and rows[p, c][1] is not None and rows[p, c][2] > 0
    live, before, out = [], {}, {}
    for p in range(last + 1):
        for s, codes in signals.items():
            end = min(s + horizon, last)
            if s + 1 == p and s + 1 <= end and (held := [c for c in codes if buy(p, c)]):
                live.append((p, end, held))
        weight = lambda cs: {c: sum(1 / horizon / len(h) for _, _, h in cs if c in h) for c in {c for _, _, h in cs for c in h}}
        w = weight(live)
        opens = {c for s, _, h in live if s == p for c in h}
        value = total = 0.0
        for c, x in w.items():
            if (p, c) not in rows:
                continue
            r = rows[p, c][1 if c in opens else 0]
            r = 0.0 if r is None and rows[p, c][3] else r
            if r is not None:
                value, total = value + x * r, total + x
        blocked = 0
        after = []
        for s, e, h in live:
            if p >= e:
                stay = [c for c in h if not free(p, c, 1 if s == p else 0)]
                blocked += len(stay)
                h = stay
            if h:
                after.append((s, e, h))
        w_end = weight(after)
        diff = lambda a, b: sum(abs(a.get(c, 0) - b.get(c, 0)) for c in {*a, *b})
        if live:
            out[p] = (value / total if total else None, total, diff(before, w), diff(w, w_end), len(w), blocked, len(live))
        live, before = after, w_end
    return out


@pytest.mark.parametrize(("seed", "horizon"), [(1, 1), (2, 5)])
def test_overlapping_book_equals_simulation(spark, seed, horizon):
    import random

    rng = random.Random(seed)
    codes, days = 8, 25
    rows = world(rng, codes, days)
    picks = {s: rng.sample(range(codes), 5) for s in range(0, days - 1) if rng.random() < 0.7}
    name = lambda c: f"{c:06d}"
    daily = spark.createDataFrame([(D(p), name(c), *v) for (p, c), v in rows.items()], "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    pred = spark.createDataFrame([(D(s), name(c), "E", "m", "all", horizon, 10) for s, cs in picks.items() for c in cs], "date date, code string, experiment_name string, model_name string, universe_group string, horizon int, decile int")
    got = {(r.date - D(0)).days: r for r in portfolio.portfolio_days(pred, daily, EngineConfig()).collect()}
    wanted = simulate(rows, picks, horizon, days - 1)
    for p, (ret, valid, start, end, n, blocked, cohorts) in wanted.items():
        r = got[p]
        assert (r.gross_return is None) == (ret is None) and (ret is None or abs(r.gross_return - ret) < 1e-12)
        assert abs(r.valid_weight - valid) < 1e-12 and abs(r.start_turnover - start) < 1e-12 and abs(r.end_turnover - end) < 1e-12
        assert (r.num_holdings, r.num_blocked_sells, r.active_cohorts) == (n, blocked, cohorts)
    assert all(r.gross_return == 0.0 for p, r in got.items() if p not in wanted)


def test_compounding_check_reads_all_rows(spark):
    from tapeline.plans import portfolio_queries

    days, codes = 105, [f"{k:06d}" for k in range(100)]
    daily = spark.createDataFrame([(D(n), c, 0.01, 0.02, 1.0, 0, 0, 0) for n in range(days) for c in codes], "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    wrong = (D(days - 3), codes[-1])
    pred = spark.createDataFrame([(D(n), c, 2, 1.02 * 1.01 - 1 + (0.5 if (D(n), c) == wrong else 0.0)) for n in range(days - 2) for c in codes], "date date, code string, horizon int, future_ret double")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(portfolio_queries, "ranked", lambda *_: pred)
        patch.setattr(portfolio_queries, "week_features", lambda *_: daily)
        whole = portfolio_queries.compounding_check(spark, "").first()
    assert whole.n_rows == (days - 2) * len(codes) > 10_000 and math.isclose(whole.max_difference, 0.5)
    assert portfolio.compounding_check(pred, daily, check_rows=50).first().n_rows == 50


def test_stored_steps(spark):
    """A stored step keeps its types and rows, empty ones too, and is gone after its owner closes."""
    from tapeline.sinks import stored

    df = spark.createDataFrame([(D(0), None, 1.5, [1]), (D(0), None, 1.5, [1]), (None, "a", None, [])], "`a b` date, code string, x double, y array<int>")
    with stored.Steps() as steps:
        for one in (df, df.limit(0)):
            found = stored.stored(one)
            assert found.dtypes == one.dtypes and sorted(map(str, found.collect())) == sorted(map(str, one.collect()))
        paths = found.inputFiles() + [p for _, p in steps.kept]
    assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_costs_and_performance(spark):
    days = spark.createDataFrame([(D(i), "E", "m", "all", d, f"D{d}", g, 0.5, 0.25, 0.25, 1, 3, 0.9, g, g, 0.0, 0.0, i == 0) for i, g in enumerate((0.1, -0.2, 0.3)) for d in (1, 10)], "date date, experiment_name string, model_name string, universe_group string, decile int, portfolio_name string, gross_return double, turnover double, start_turnover double, end_turnover double, active_cohorts int, num_holdings int, valid_weight double, signal_gross_alpha double, buy_constrained_gross_return double, buy_blocked_loss double, sell_blocked_forced_hold_loss double, is_warmup boolean")
    cfg = EngineConfig(costs_bps=(0.0, 100.0))
    costs = performance.with_costs(days, cfg)
    assert costs.where("abs(attributed_net_return - net_return) > 1e-15").count() == 0
    p = {(r.decile, r.cost_bps): r for r in performance.performance(costs, cfg).collect()}
    assert p[10, 0.0].n_periods == 2 and p[10, 0.0].n_warmup_days == 1 and abs(p[10, 0.0].final_net_nav - 0.8 * 1.3) < 1e-12 and p[10, 0.0].max_drawdown == 0.0 and p[10, 0.0].win_rate == 0.5
    ls = performance.long_short(costs).where("cost_bps = 100").orderBy("date").collect()
    assert [round(r.net_return, 12) for r in ls] == [-0.01] * 3 and ls[0].is_warmup
    assert performance.nav(costs).count() == 8


def test_writers_and_stages(spark, tmp_path):
    from tapeline.plans import base, pipeline
    from tapeline.sinks import writers

    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    sf = "/root/testdata/sf0.001"
    p = base.week_panel(spark, sf)
    writers.by_code(panel.to_storage(p), f"{tmp_path}/code")
    back = spark.read.parquet(f"{tmp_path}/code")
    assert dict(back.dtypes)["code"] == "string" and back.count() == p.count() and back.where("length(code) <> 6").count() == 0
    b = base.weekly(spark, sf)
    from tapeline.sources import bars

    pipeline.build_panel(bars.raw_prices(b), bars.adjusted_prices(b), base.CFG, str(tmp_path))
    pipeline.build_features(spark, base.CFG, str(tmp_path))
    pipeline.check_quality(spark, base.CFG, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/features_by_year").count() == p.count() and spark.read.json(f"{tmp_path}/qa/features").count() == 7
    writers.csv_table(spark.createDataFrame([], "a int, b array<string>"), f"{tmp_path}/empty", "")


def test_price_files_in_several_encodings(spark, tmp_path):
    from tapeline.sources import prices

    (tmp_path / "000001.csv").write_bytes("日期,代码,收盘\n2020-01-02,sz000001,\"1,5\"\n".encode("gbk"))
    (tmp_path / "000002.csv").write_bytes("日期,代码\n2020-01-03,2\n".encode("utf-8-sig"))
    df = prices.read_prices(spark, str(tmp_path), {"日期": "date", "代码": "code", "收盘": "close"}, ["close"], [], [], EngineConfig())
    assert sorted((r.code, str(r.date), r.close) for r in df.collect()) == [("000001", "2020-01-02", 15.0), ("000002", "2020-01-03", None)]
    raw = prices.raw_table(spark, str(tmp_path), EngineConfig())
    assert set(raw.columns) == set(prices.RAW_HEADERS.values()) and raw.where("is_st = 0 and volume is null").count() == 2


def test_streaming_bars(spark, tmp_path):
    from tapeline.streaming.bars import streaming_bars

    spark.createDataFrame([("2020-01-01 01:00:00", "a", 1.0, 1), ("2020-01-01 05:00:00", "a", 3.0, 2), ("2020-01-01 02:00:00", "a", 2.0, 3), ("2020-01-09 00:00:00", "a", 9.0, 4)], "t string, k string, v double, id long").selectExpr("cast(t as timestamp) as t", "k", "v", "id").write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema("t timestamp, k string, v double, id long").parquet(f"{tmp_path}/in")
    q = streaming_bars(ticks, "t", "k", "v", ["id"]).writeStream.outputMode("append").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.open, r.high, r.low, r.close, r.n) for r in spark.table("bars").collect()] == [(1.0, 3.0, 1.0, 3.0, 3)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(found) > 40


def test_aggregate_members(spark, tmp_path):
    from tapeline.plans import pipeline

    rows = [(f"2020-01-0{d}", f"00000{c}", float(c * (f + 1) + s), 0.5, 0.1, "bce", "I5R5", f, s) for d in (1, 2) for c in range(4) for f in range(2) for s in range(2)]
    schema = "date string, code string, pred_score_raw double, pred_probability double, future_ret double, loss string, experiment string, fold int, seed int"
    df = spark.createDataFrame(rows, schema)
    df.write.partitionBy("loss", "experiment").parquet(f"{tmp_path}/members")
    pipeline.aggregate(spark, f"{tmp_path}/members", "bce", "I5R5", str(tmp_path), folds=2, seeds=2)
    out = spark.read.parquet(f"{tmp_path}/predictions/I5R5_bce").collect()
    deviation = (5 / 4) ** 0.5
    assert len(out) == 8 and all(abs(r.pred_score - (int(r.code) - 1.5) / deviation) < 1e-9 and r.ensemble_member_count == 4 for r in out)
    df.where("not (code = '000003' and fold = 1)").write.partitionBy("loss", "experiment").parquet(f"{tmp_path}/short")
    with pytest.raises(ValueError, match="each member"):
        pipeline.aggregate(spark, f"{tmp_path}/short", "bce", "I5R5", str(tmp_path), folds=2, seeds=2)
    df.selectExpr("date", "code", "1.0 pred_score_raw", "pred_probability", "future_ret", "loss", "experiment", "fold", "seed").write.partitionBy("loss", "experiment").parquet(f"{tmp_path}/flat")
    with pytest.raises(ValueError, match="standardised"):
        pipeline.aggregate(spark, f"{tmp_path}/flat", "bce", "I5R5", str(tmp_path), folds=2, seeds=2)


def test_pixels_are_numbers_until_the_end(spark):
    """No array of pixels is told apart or sorted as structs, and no lambda holds a sort: both were quadratic in an image's pixels."""
    day = (1.0, 2.0, 0.5, 1.5, 10.0, 1.2)
    valid = spark.createDataFrame([(dt.date(2000, 1, 3), "000001", 0.5, 2.0, 10.0, [day] * 5)], "date date, code string, p_min double, p_max double, amount_max double, days array<struct<o:double,h:double,l:double,c:double,a:double,m:double>>")
    lit = images.pixels(valid, 5, EngineConfig())
    plan = images.dense(lit, 5, EngineConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 2 and "array_sort(" not in plan and "array_distinct(" in plan
    assert not any("sort_array(" in part.split("lambdafunction(", 1)[1].split("lambda", 1)[0] for part in plan.split("transform(") if "lambdafunction(" in part)
    found = [(p.x, p.y) for p in lit.first().pixels]
    assert found == sorted(set(found))


def test_drawn_images_are_the_pixels(spark):
    """Images drawn for many windows at once, a few at a time, are those of the pixels, and no lambda draws them in the queries."""
    rng = random.Random(11)
    schema = "date date, code string, label_5d double, p_min double, p_max double, amount_max double, days array<struct<o:double,h:double,l:double,c:double,a:double,m:double>>"

    def one(window, k):
        # eighths and halves lie on the edges of rows, where rounding is half to even
        prices = [sorted(rng.randrange(0, 33) / 8 for _ in range(4)) for _ in range(window)]
        days = [(p[1], p[3], p[0], p[2], rng.randrange(0, 5) / 2, rng.randrange(0, 33) / 8) for p in prices]
        lo, hi = min(min(d[2], d[5]) for d in days), max(max(d[1], d[5]) for d in days)
        return (dt.date(2000, 1, 3) + dt.timedelta(days=k), "000001", None if k % 3 else 1.0, lo, hi, max(d[4] for d in days) or 1.0, days)

    for window, n in ((1, 40), (5, 300), (20, 60), (60, 12)):
        rows = [r for r in (one(window, k) for k in range(n)) if r[4] > r[3]]
        valid = spark.createDataFrame(rows, schema)
        made, wanted = images.drawn(valid, window, EngineConfig()), images.dense(images.pixels(valid, window, EngineConfig()), window, EngineConfig())
        assert made.columns == wanted.columns and made.count() == len(rows)
        assert made.exceptAll(wanted).count() == 0
    assert images.drawn(spark.createDataFrame([], schema), 5, EngineConfig()).count() == 0
    from tapeline.plans import queries

    plan = queries.image_qa(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_distinct(" not in plan and "regexp_replace(" not in plan


def test_compared_images_over_a_sample_and_all(spark):
    """Pixels that differ, by their sizes, also where one image is shorter; a sample is chosen without one task for all keys."""
    from tapeline.operators import qa

    rows = [(dt.date(2000, 1, 3), f"{i:06}", bytearray([0, 255, 0]), 1.0, 0.5) for i in range(40)]
    new = spark.createDataFrame(rows, "date date, code string, image binary, label_5d double, future_ret_5d double")
    old = new.withColumn("image", F.when(F.col("code") == "000003", F.unhex(F.lit("00F800"))).when(F.col("code") == "000004", F.unhex(F.lit("00FF"))).otherwise(F.col("image")))
    row = qa.compare_images(new, old, 1_000_000_000, (5,)).first()
    assert (row.n_common, row.n_sampled, row.n_pixel_mismatch, row.max_pixel_difference, row.n_value_mismatch) == (40, 40, 2, 7, 0)
    some = qa.compare_images(new, old, 10, (5,))
    assert (some.first().n_common, some.first().n_sampled) == (40, 10)
    assert "TakeOrdered" not in some._jdf.queryExecution().executedPlan().toString()


def test_books_explode_where_a_code_lies(spark):
    """Exploded positions are neither sent nor written: the only exchange by day is that of sums by book, and duplicates of positions count once."""
    d = lambda i: dt.date(2000, 1, 3) + dt.timedelta(days=i)
    daily = spark.createDataFrame([(d(i), f"{c:06}", 0.01 * c, 0.02, 5.0, int(c == 1 and i == 3), 0, 0) for i in range(8) for c in range(3)], "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    rows = [(d(i), f"{c:06}", "e", m, "all", 2, 1) for i in (0, 1, 2) for c in range(3) for m in ("m", None)]
    schema = "date date, code string, experiment_name string, model_name string, universe_group string, horizon int, decile int"
    cal, days = portfolio.placed(daily)
    sig, _ = portfolio.coded(portfolio.signals(spark.createDataFrame(rows, schema), cal, True))
    held = portfolio.held_days(portfolio.executed(sig, days, 3), days, True, 3)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(code") == 1 and "hashpartitioning(pos" not in plan and "hashpartitioning(g" not in plan
    once, twice = (sorted(map(str, portfolio.portfolio_days(spark.createDataFrame(r, schema), daily, EngineConfig()).collect())) for r in (rows, rows * 2))
    assert once == twice and once


def test_periods_are_dealt_over_more_partitions_for_more_rows(spark, monkeypatch):
    """One exchange by period and model, whose partitions grow with the rows; ranks, deciles and sums need no other, and one sort for a value's average ranks."""
    rows = [(dt.date(2000, 1, 1 + k % 20), f"{k:06}", "e", "m", float(k % 7), float(k % 5), 1.0 * k, 5) for k in range(200)]
    pred = spark.createDataFrame(rows, "date date, code string, experiment_name string, model_name string, score double, future_ret double, float_mktcap double, horizon int")
    monkeypatch.setattr(cross_section, "TASK_ROWS", 16)
    out = cross_section.ic_by_period(cross_section.universes(cross_section.dealt(pred, 200)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "experiment_name" in plan and ", 13)" in plan
    monkeypatch.setattr(cross_section, "TASK_ROWS", 1 << 16)
    plain = cross_section.ic_by_period(cross_section.universes(cross_section.dealt(pred, 200)))
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    assert plan.count("rank(") >= 2 and plan.count("+- Sort [") <= 3


def test_ticks_are_sent_once_and_features_stay(spark, monkeypatch):
    """One exchange and one sort by code from ticks to features, over more partitions for more ticks; the panel equals the outer join's."""
    from tapeline.plans import base
    from tapeline.sources import bars

    sf = "/root/testdata/sf0.001"
    joined, pairs = base.joined_panel(spark, sf), base.week_panel(spark, sf)
    assert joined.dtypes == pairs.dtypes and joined.exceptAll(pairs).isEmpty() and pairs.exceptAll(joined).isEmpty() and pairs.where("name is null").head(1)
    monkeypatch.setattr(bars, "TASK_TICKS", 500)
    plan = base.week_features(spark, sf)._jdf.queryExecution().executedPlan().toString()
    ticks = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert plan.count("Exchange hashpartitioning(") == 1 and f", {-(-ticks // 500)})" in plan and plan.count("+- Sort [") == 1


def test_split_by_known_dates(spark):
    """The same split, and the sample is read once."""
    rows = [(dt.date(1999, 1, 4) + dt.timedelta(days=3 * k), k) for k in range(400)]
    df = spark.createDataFrame(rows, "date date, k int")
    cfg = EngineConfig(train_end=dt.date(1999, 12, 31), valid_start=dt.date(2000, 1, 1), valid_end=dt.date(2000, 12, 31), test_start=dt.date(2001, 1, 1))
    days = spark.createDataFrame([(d,) for d, _ in rows], "date date").localCheckpoint()
    plain, known = targets.fixed_split(df, 5, cfg), targets.fixed_split(df, 5, cfg, days)
    assert sorted(map(str, plain.collect())) == sorted(map(str, known.collect()))
    assert plain.where("split = 'valid'").count() > 100


def test_ranks_stay_where_scores_are_dealt(spark, monkeypatch):
    """The queries' own scores are sent once, to more partitions for more rows: windows by period find them there."""
    from tapeline.plans import base

    f = base.kept(base.week_features(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(cross_section, "TASK_ROWS", 100)
    plan = base.ranked(f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and f", {-(-2 * f.count() // 100)})" in plan


def test_deciles_of_all_universes_by_one_sort(spark):
    """Equal to deciles of repeated rows, with ties, values without a size and groups too small for deciles; two sorts in all."""
    rows = [(dt.date(2000, 1, 3 + k % 3), f"{k:06}", "e", ("m", "n")[k % 2], float(k * 7 % 11), 0.1, float(k * 5 % 13) if k % 4 else None, 5) for k in range(150)]
    rows += [(dt.date(2000, 1, 9), f"{k:06}", "e", "m", 1.0, 0.1, None if k else 2.0, 5) for k in range(12)]
    pred = spark.createDataFrame(rows, "date date, code string, experiment_name string, model_name string, score double, future_ret double, float_mktcap double, horizon int")
    plain, fused = cross_section.deciles(cross_section.universes(pred)), cross_section.universe_deciles(pred)
    assert plain.dtypes == fused.dtypes and sorted(map(str, plain.collect())) == sorted(map(str, fused.collect()))
    assert fused.where("decile is null").count() and fused.where("decile = 10").count()
    assert fused._jdf.queryExecution().executedPlan().toString().count("+- Sort [") == 2


def test_sizes_of_universes_by_counts(spark):
    """Counts alone give the rows of every universe, whatever the number of rows with a market value."""
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=v), f"{k:06}", "e", "m", float(k % 5) if k < v else None) for v in range(40) for k in range(v + v % 3)]
    pred = spark.createDataFrame(rows, "date date, code string, experiment_name string, model_name string, float_mktcap double")
    counted = cross_section.universes(pred).groupBy(*cross_section.PERIOD).count()
    sizes = cross_section.universe_sizes(pred).select(*counted.columns[:-1], "n")
    assert sorted(map(str, counted.withColumnRenamed("count", "n").collect())) == sorted(map(str, sizes.collect())) and counted.count() > 100


def test_rebalances_rank_their_days_alone(spark):
    """Ranks of rebalance days equal those cut from all days' ranks, from each universe's own first day on; other days' scores aren't ranked."""
    from tapeline.plans import base

    # codes come one by one, so that universes reach ten rows one after another; the second model's scores come later
    rows = [(dt.date(2000, 1, 3) + dt.timedelta(days=k), f"{c:06}", float(c * 7 % 13 + k % 3), float(c * 5 % 11) if k > 6 else None, 0.1 * c, 1.0, float(c * 3 % 17) if c % 6 else None) for k in range(50) for c in range(k + 6)]
    f = base.kept(spark.createDataFrame(rows, "date date, code string, reversal_5d double, momentum_20d double, future_ret_5d double, label_5d double, float_mktcap double"))
    cal = portfolio.trading_days(f)
    whole = base.ranked(f).join(cal, "date")
    known = whole.where("decile is not null")
    own = ["date", "code", *cross_section.GROUP, "decile"]
    for together in (False, True):
        keys = ["universe_group"] if together else cross_section.GROUP
        first = known.groupBy(*keys, "date", "pos").agg(F.countDistinct("model_name").alias("m")).where(f"m >= {1 + together}").groupBy(*keys).agg(F.min("pos").alias("first"))
        expected = known.join(first, keys).where("pos >= first and (pos - first) % 5 = 0").select(*own)
        found = base.rebalanced(f, cal, together)
        at = found.where("decile is not null").join(cal, "date").join(first, keys).where("(pos - first) % 5 = 0").select(*own)
        assert sorted(map(str, expected.collect())) == sorted(map(str, at.collect())) and expected.count() > 100
        assert first.select("first").distinct().count() > 1
        assert found.select("date").distinct().count() < known.select("date").distinct().count()


def test_holdings_send_first_days_alone(spark):
    """What opens equals ``executed`` over all days; the plan holds one join of positions and days by code, and no window by code."""
    rng = random.Random(5)
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=k) for k in range(32)]
    flag = lambda p: int(rng.random() < p)
    number = lambda: None if rng.random() < 0.1 else rng.random()
    rows = [(d, f"{c:06}", number(), number(), float(rng.randrange(3)), flag(0.1), flag(0.2), flag(0.2)) for d in days for c in range(60) if rng.random() < 0.9]
    daily = spark.createDataFrame([*rows, *rows[:50]], "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    pred = spark.createDataFrame([(d, f"{c:06}", "e", m, "all", 5, 1 + (c * 7 + k) % 10) for k, d in enumerate(days) for c in range(60) for m in ("logistic", "cnn") if k >= (m == "cnn")], "date date, code string, experiment_name string, model_name string, universe_group string, horizon int, decile int")
    market = portfolio.placed(daily)
    expected = {}
    for decile, short in ((10, False), (1, True)):
        sig, names = portfolio.coded(portfolio.signals(pred.where(F.col("decile") == decile), market.calendar, False))
        for r in portfolio.executed(sig, market.days, 3, short).where("open").select("code", "start", F.inline("tags")).join(names, "g").collect():
            expected.setdefault((r.model_name, r.start, short), set()).add(r.code)
    pos = {r.date: r.pos for r in market.calendar.collect()}
    for source in (daily, market):
        held = portfolio.holdings(pred, source)
        found = {(r.model_name, pos[r.rebalance_date], r.leg == "short"): set(r.codes) for r in held.where("portfolio_name = 'D10_minus_D1'").collect()}
        assert {k: v for k, v in found.items() if v} == expected and len(expected) > 10
        top = lambda name: sorted((r.model_name, r.rebalance_date, r.codes) for r in held.where(f"portfolio_name = '{name}' and leg = 'long'").collect())  # noqa: E731, B023
        assert top("D10") == top("D10_minus_D1") and all(codes == sorted(codes) for *_, codes in top("D10"))
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("collect_set(") == 1
    overlap = portfolio.holding_overlap(portfolio.holdings(pred, daily))
    assert overlap._jdf.queryExecution().optimizedPlan().toString().count("collect_set(") == 1


@pytest.mark.parametrize(("seed", "overlapping", "chunk"), [(3, True, 1), (4, False, 1), (5, True, 1 << 16)])
def test_book_days_by_arrays_equal_rows(spark, monkeypatch, seed, overlapping, chunk):
    """Sums by arrays, over a code at a time or all at once, are those of the rows, and positions are not exploded by Spark."""
    from tapeline.operators import books

    rng = random.Random(seed)
    rows = world(rng, 12, 30)
    daily = spark.createDataFrame([(D(p), f"{c:06d}", *v) for (p, c), v in rows.items()], "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    picks = [(D(s), f"{c:06d}", "e", m, "all", 5 if m == "a" else 3, rng.choice([1, 1, 2, 10])) for m in "ab" for s in range(29) for c in range(12) if rng.random() < 0.6]
    pred = spark.createDataFrame(picks, "date date, code string, experiment_name string, model_name string, universe_group string, horizon int, decile int")
    cal, d = portfolio.placed(daily)
    sig, _ = portfolio.coded(portfolio.stored(portfolio.signals(pred, cal, overlapping)))
    monkeypatch.setattr(books, "CHUNK", chunk)
    pos = portfolio.executed(sig, d, 3)
    made = portfolio.portfolio_sums(pos, d, overlapping, 3)
    monkeypatch.setattr(portfolio, "BROADCAST_BYTES", 0)
    wanted = portfolio.portfolio_sums(pos, d, overlapping, 3)
    assert sorted(made.columns) == sorted(wanted.columns)
    key = lambda r: (r.g, r.decile, r.pos)
    one, two = ({key(r): r.asDict() for r in df.collect()} for df in (made, wanted))
    assert one.keys() == two.keys() and len(one) > 100
    for k, a in one.items():
        for c, v in two[k].items():
            if c.endswith(("_valid", "_missing", "_leaving")) or c == "actual_cohorts":
                v = v or 0  # none is nothing
            assert a[c] == v or abs(a[c] - v) < 1e-9, (k, c, a[c], v)
    days = spark.createDataFrame([], "code string, pos int, ret double, o2c double, susp int")
    asked = spark.createDataFrame([], "code string, signal_pos int, horizon int, start int, end int, last int, gone long, open boolean, unknown boolean, tags array<struct<g:int,decile:int>>")
    plan = books.summed_days(asked, days, [], overlapping)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(" not in plan


def test_deciles_by_arrays_equal_rows(spark):
    """Ties, values without a size, NaN, zeros of both signs and groups too small for deciles: the same rows, ranked without a window of Spark."""
    nan, codes = float("nan"), [f"{k * 37 % 150:06}" for k in range(150)]
    rows = [(dt.date(2000, 1, 3 + k % 3), codes[k], "e", ("m", "n")[k % 2], (nan, -0.0, 0.0)[k // 3 % 3] if k % 5 == 0 else float(k * 7 % 11), 0.1, (float(k * 5 % 13), nan)[k % 9 == 1] if k % 4 else None, 5) for k in range(150)]
    rows += [(dt.date(2000, 1, 9), f"{k:06}", "e", "m", 1.0, 0.1, None if k else 2.0, 5) for k in range(12)]
    pred = spark.createDataFrame(rows, "date date, code string, experiment_name string, model_name string, score double, future_ret double, float_mktcap double, horizon int")
    plain, made = cross_section.universe_deciles(pred), cross_section.array_deciles(pred, 1)
    assert plain.columns == made.columns and [f.dataType for f in plain.schema] == [f.dataType for f in made.schema]
    assert sorted(map(str, plain.collect())) == sorted(map(str, made.collect()))
    plan = cross_section.array_deciles(pred, 1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Exchange hashpartitioning(") == 1
    some = ["date", "code", "model_name"]
    assert sorted(map(str, plain.select(*some, "universe_group", "decile").collect())) == sorted(map(str, cross_section.array_deciles(pred, 1, keep=some).collect()))
    assert cross_section.array_deciles(pred.limit(0), 0).count() == 0


def test_bytes_of_images_are_told_apart_one_by_one(spark):
    """Halves of two bytes that look like 00 or FF are no pixel values, and all others are found, without a pattern over the digits."""
    found = [b"\x00\xff" * 3, b"\x0f\xf0", b"\xf0\x0f", b"\x00\x01", b"\xc3\xbf", b"\xff\xff"]
    df = spark.createDataFrame([(D(k), "1", bytearray(b), 1.0, 1.0) for k, b in enumerate(found)], "date date, code string, image binary, label_5d double, future_ret_5d double")
    checked = qa.images(df, 1, 2, (5,))
    row = checked.first()
    assert (row.n_images, row.n_not_binary, row.n_wrong_size) == (6, 4, 1)
    assert "regexp_replace" not in checked._jdf.queryExecution().optimizedPlan().toString()
