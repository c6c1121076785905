"""Layouts that later plans can use, single CSV files, date batches, intake of files, compounding by running sums."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.operators import batches, features, portfolio
from tapeline.plans import base
from tapeline.sinks import writers
from tapeline.sinks.stored import Steps
from tapeline.streaming.intake import take_in

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def prices(spark):
    """A panel of which one year has nearly all rows."""
    rng = random.Random(2)
    rows = [(D(k), f"{c:06d}", *(10.0 + rng.random() for _ in range(4)), 1e4, 3e7, 0, 0, 1) for c in range(40) for k in range(300)] + [(D(400 + k), "000001", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, 0, 1) for k in range(9)]
    return spark.createDataFrame(rows, "date date, code string, open_adj double, high_adj double, low_adj double, close_adj double, volume double, amount double, is_st int, is_suspended int, is_tradable_basic int").withColumns({"pct_chg": F.lit(1.0), "days_since_list": F.lit(500.0), "list_date": F.lit(None).cast("date")}).cache()


def test_a_large_year_is_many_files(spark, prices, tmp_path):
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        writers.by_year(prices, str(tmp_path / "year"), file_rows=2500)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    at = {y: list((tmp_path / f"year/year={y}").glob("*.parquet")) for y in (2020, 2021)}
    assert len(at[2020]) >= 5 and len(at[2021]) == 1
    assert all(spark.read.parquet(str(f)).count() <= 2500 for own in at.values() for f in own)
    assert len({f.name.split("-")[1] for f in at[2020]}) > 1  # of several tasks
    assert spark.read.parquet(str(tmp_path / "year")).count() == prices.count()


def test_small_parts_are_put_together(spark, prices, tmp_path):
    writers.by_bucket(prices.repartition(40), str(tmp_path / "bucket"), buckets=3)
    assert [len(list((tmp_path / f"bucket/bucket={b}").glob("*.parquet"))) for b in range(3)] == [1, 1, 1]
    writers.by_code(prices, str(tmp_path / "code"))
    assert len(list((tmp_path / "code").glob("code=*/*.parquet"))) == 40


def test_windows_over_a_bucketed_table_need_no_exchange(spark, prices, tmp_path):
    writers.bucketed_table(prices, "panel_in_buckets", 8, str(tmp_path / "table"))
    try:
        assert len(list((tmp_path / "table").glob("*.parquet"))) <= 8
        f = features.build_features(spark.table("panel_in_buckets"), base.CFG)
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan
        both = f.select("date", "code", "ma5_gap", "vol_20d", "is_tradable").exceptAll(features.build_features(prices, base.CFG).select("date", "code", "ma5_gap", "vol_20d", "is_tradable"))
        assert f.count() == prices.count() and both.count() == 0
    finally:
        spark.sql("drop table panel_in_buckets")


def test_what_is_written_is_counted_in_the_same_pass(spark, prices, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    bad = prices.union(prices.limit(2).withColumn("code", F.lit(None).cast("string")))
    found = writers.observed(bad, lambda df: writers.by_year(df, str(tmp_path / "y")), range(2020, 2023))
    assert found["rows"] == prices.count() + 2 and found["null_keys"] == 2 and (found["year_2020"], found["year_2021"], found["year_2022"]) == (prices.count() + 2 - 9, 9, 0)
    assert found["first"] == D(0) and found["last"] == D(408) and reads.value == 0


def test_one_csv_file(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select("id", F.concat(F.lit('a "b", '), F.col("id")).alias("x, y"), F.when(F.col("id") % 3 == 0, F.lit(0.1) * F.col("id")).alias("价"), F.array(F.lit("b"), F.lit("a")).alias("codes"))
    writers.csv_file(df, f"{tmp_path}/t.csv")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.csv"]
    plain = df.withColumn("codes", F.lit("a|b"))
    plain.coalesce(1).write.option("header", False).csv(f"{tmp_path}/plain")
    body = next((tmp_path / "plain").glob("part-*.csv")).read_bytes()
    text = (tmp_path / "t.csv").read_bytes()
    assert text.startswith("﻿id,\"x, y\",价,codes\n".encode()) and text.count("﻿".encode()) == 1
    rest = text.split(b"\n", 1)[1]
    parts = sorted((tmp_path / "plain").glob("part-*.csv"))
    assert len(parts) == 1 and rest == body
    writers.csv_file(df.limit(2), f"{tmp_path}/t.csv", append=True)
    assert (tmp_path / "t.csv").read_bytes().startswith(text) and (tmp_path / "t.csv").read_bytes().count(b"\n") == 1003
    writers.csv_file(df.limit(0), f"{tmp_path}/empty.csv")
    assert (tmp_path / "empty.csv").read_bytes() == "﻿id,\"x, y\",价,codes\n".encode()


def test_a_failed_csv_leaves_what_was_there(spark, tmp_path):
    writers.csv_file(spark.range(2), f"{tmp_path}/t.csv")
    before = (tmp_path / "t.csv").read_bytes()
    with pytest.raises(Exception, match="no good"):
        writers.csv_file(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("no good"))).otherwise(F.col("id"))), f"{tmp_path}/t.csv")
    assert (tmp_path / "t.csv").read_bytes() == before and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.csv"]


def test_csv_keeps_the_tasks_of_the_last_stage(spark, tmp_path):
    began = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("csv", "csv")
    writers.csv_file(spark.range(0, 100, 1, 6).select((F.col("id") * 2).alias("x")), f"{tmp_path}/t.csv")
    jobs = [began.getJobInfo(j) for j in began.getJobIdsForGroup("csv")]
    spark.sparkContext.setJobGroup("", "")
    assert max(began.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) == 6
    assert [int(x) for x in (tmp_path / "t.csv").read_text("utf-8-sig").split()[1:]] == list(range(0, 200, 2))


def test_batches_of_the_fixture(spark):
    """Positions in a split of rows, in order of date and code."""
    df = spark.createDataFrame([(0, dt.date(2020, 1, 2), "000001"), (1, dt.date(2020, 1, 1), "000002"), (2, dt.date(2020, 1, 1), "000001")], "position int, date date, code string")
    with Steps():
        found = batches.date_batches(df, 1000).orderBy("batch", "place").collect()
    assert [(r.batch, r.place, r.position) for r in found] == [(0, 0, 2), (0, 1, 1), (1, 0, 0)]


def test_batches_don_t_depend_on_partitions(spark):
    rows = [(D(k), f"{c:06d}") for k in range(30) for c in range(1 + 7 * (k % 5))] + [(D(99), f"{c:06d}") for c in range(900)] + [(None, "x")]
    random.Random(1).shuffle(rows)
    df, results = spark.createDataFrame(rows, "date date, code string"), []
    for n in (1, 5, 13):
        with Steps():
            batched = batches.date_batches(df.repartition(n), 20)
            results.append(sorted((r.batch, r.place, r.date, r.code) for r in batched.collect()))
            dealt = batches.dealt(batched, 4)
            parts = dealt.select(F.spark_partition_id().alias("p"), "batch", "place").collect()
    assert results[0] == results[1] == results[2]
    own, want = results[0], []
    for d in sorted({d for d, _ in rows if d}):
        codes = sorted(c for x, c in rows if x == d)
        want += [(d, codes[i : i + 20]) for i in range(0, len(codes), 20)]
    assert [(d, [r[3] for r in own if r[0] == k]) for k, (d, _) in enumerate(want)] == want
    assert len({(r.p, r.batch) for r in parts}) == len(want)
    for p in {r.p for r in parts}:
        assert [(r.batch, r.place) for r in parts if r.p == p] == sorted((r.batch, r.place) for r in parts if r.p == p)
    with pytest.raises(ValueError, match="a row at least"):
        batches.date_batches(df, 0)


PRED = "date date, code string, future_ret double, float_mktcap double, horizon int, experiment_name string, model_name string, pred_score double"


def test_files_are_taken_in_once(spark, tmp_path):
    def put(name, n):
        rows = [(D(i), f"{i:06d}", 0.1, 1.0, 5, "I5R5", name, float(i) if i else None) for i in range(n)]
        spark.createDataFrame(rows, PRED).coalesce(1).write.parquet(f"{tmp_path}/new")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / "new").glob("part-*")).rename(tmp_path / f"in/pred_{name}.parquet")
        for p in (tmp_path / "new").iterdir():
            p.unlink()
        (tmp_path / "new").rmdir()

    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", PRED)
    for name, n in (("a", 4), ("b", 3), ("c", 6)):
        put(name, n)
    assert take_in(*args, max_files=2) == 2
    count = lambda: {r.model_name: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("model_name").count().collect()}
    assert count() == {"a": 3, "b": 2, "c": 5}
    assert take_in(*args) == 0 and count() == {"a": 3, "b": 2, "c": 5}
    put("d", 3)
    assert take_in(*args) == 1 and count()["d"] == 2
    # stopped between the batch's rows and the checkpoint's word of them: the batch comes again, and counts once
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert take_in(*args) == 1 and count() == {"a": 3, "b": 2, "c": 5, "d": 2}


def test_compounding_by_running_sums(spark):
    rng = random.Random(7)
    days, codes = 40, [f"{c:06d}" for c in range(6)]
    daily, ret = [], {}
    for c in codes:
        for k in range(days):
            if rng.random() < 0.03:
                continue
            r = rng.choice([None, -1.0, -2.5] + [rng.gauss(0, 0.05)] * 30)
            o = rng.choice([None] + [rng.gauss(0, 0.05)] * 20)
            ret[c, k] = (r, o)
            daily.append((D(k), c, r, o, 100.0, 0, 0, 0))
    d = spark.createDataFrame(daily, "date date, code string, ret_1d double, open_to_close_ret_1d double, volume double, is_suspended int, is_low_volume_limit_up int, is_low_volume_limit_down int")
    want, rows = [], []
    for c in codes:
        for k in range(days):
            for h in (1, 5, 20):
                own = [ret.get((c, k + i), (None, None))[0 if i > 1 else 1] for i in range(1, h + 1)]
                f = rng.gauss(0, 0.1)
                rows.append((D(k), c, h, f))
                if k + h < days and None not in own:
                    want.append(abs(math.prod(1 + x for x in own) - 1 - f))
    pred = spark.createDataFrame(rows, "date date, code string, horizon int, future_ret double")
    with Steps():
        check = portfolio.compounding_check(pred, d)
        found = check.first()
        assert found.n_rows == len(want) > 100 and found.max_difference == pytest.approx(max(want), abs=1e-9)
        plan = check._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        assert "differs" in portfolio.warned(check, 1e-6) and portfolio.warned(check, 1e6) is None
        assert "no row" in portfolio.warned(portfolio.compounding_check(pred.limit(0), d), EngineConfig().check_tolerance)
        began = time.time()
        portfolio.compounding_check(pred.withColumn("horizon", F.lit(39)), d).first()
        assert time.time() - began < 60
