"""All stages over one small panel, as the command line runs them."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tapeline import cli
from tapeline.config import Experiment
from tapeline.operators import qa
from tapeline.plans import base, pipeline, training
from tapeline.plans.base import CFG
from tapeline.sources import bars, shards, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    b = base.weekly(spark, SF)
    found = pipeline.build_panel(bars.raw_prices(b), bars.adjusted_prices(b), CFG, str(at), table="stages_panel")
    assert found["rows"] == base.week_panel(spark, SF).count() and not found["null_keys"]
    assert pipeline.build_features(spark, CFG, str(at), table="stages_panel")["rows"] == found["rows"]
    yield at
    spark.sql("drop table stages_panel")


def read(path):
    text = path.read_bytes()
    assert text.startswith("﻿".encode())
    return list(csv.DictReader(text.decode("utf-8-sig").splitlines()))


def test_features_are_stored_in_their_schema(spark, out):
    from tapeline import schema

    df = spark.read.parquet(f"{out}/features_by_year").drop("year")
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.features(CFG).fields]
    assert {c for c in training.FEATURES} <= set(df.columns)


def test_backtests_of_stored_predictions(spark, out):
    f = spark.read.parquet(f"{out}/features_by_year")
    pred = base.scores(f).withColumn("pred_score", F.col("score")).drop("score")
    pred.where("model_name like 'log%'").write.parquet(f"{out}/predictions/pred_a.parquet")
    pred.where("model_name like 'cnn%'").withColumn("ensemble_member_count", F.lit(20)).write.parquet(f"{out}/predictions/pred_b.parquet")
    assert tables.read_predictions(spark, f"{out}/predictions", "pred_*", 1).select("model_name").distinct().count() == 1
    both = tables.read_predictions(spark, f"{out}/predictions", "pred_*")
    daily = tables.read_daily(spark, f"{out}/features_by_year", tables.earliest_date(both))
    for overlapping in (True, False):
        with pytest.warns(UserWarning, match="compounding check"):  # weekly bars: some weeks are missing
            pipeline.evaluate(both.withColumn("future_ret", F.col("future_ret") + 0.5), daily, CFG, str(out), overlapping, table_dir=f"{out}/results")
    names = {p.name for p in (out / "results").iterdir() if not p.name.startswith(".")}
    assert {"ic_by_period.csv", "portfolio_returns.csv", "performance_summary.csv", "nonoverlap_portfolio_holdings.csv", "nonoverlap_holding_overlap_summary.csv"} <= names and all(n.endswith(".csv") for n in names)
    top = [read(out / f"results/nonoverlap_d10_long_only_{n}.csv") for n in ("returns", "nav", "performance")]
    assert all(rows and {r["portfolio_name"] for r in rows} == {"D10"} for rows in top)
    assert {"signal_date_logistic", "target_end_date_cnn", "horizon_cnn"} <= set((out / "results/nonoverlap_holding_overlap.csv").read_text("utf-8-sig").split("\n")[0].split(","))
    rows = read(out / "results/portfolio_returns.csv")
    assert len({(r["date"], r["model_name"], r["universe_group"], r["portfolio_name"], r["cost_bps"]) for r in rows}) == len(rows) > 100
    from tapeline.sinks.stored import shared_folder

    import pathlib

    assert not list(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("step-*/_temporary"))


def test_images_and_quality(spark, out):
    few = CFG.__class__(**{**CFG.__dict__, "experiments": (Experiment("I5R5", 5, 5),)})
    pipeline.build_images(spark, few, str(out), codes=4, as_shards=True)
    images = spark.read.parquet(f"{out}/images/window=5")
    assert images.select("code").distinct().count() <= 4 and images.count() > 0
    back = shards.read_shards(spark, f"{out}/shards/window_5", "date DATE, code STRING, label_5d DOUBLE, future_ret_5d DOUBLE")
    assert back.select("date", "code", "image").exceptAll(images.select("date", "code", "image")).count() == 0 and back.count() == images.count()

    years = range(1995, 2002)
    report = pipeline.check_quality(spark, few, str(out), old=str(out), sample=16, years=years)
    assert report["faults"] == [] and report["old_comparison"][5]["n_pixel_mismatch"] == 0 and report["images"][5]["labels"][0]["horizon"] == 5
    assert json.loads((out / "tables/qa/data_qa.json").read_text())["panel_by_year"][0]["year"] == 1995
    with pytest.raises(ValueError, match="no row of 1993.*not 20"):
        pipeline.check_quality(spark, few, str(out), predicted=2, members=20, years=range(1993, 2002))
    assert any("members" in x for x in json.loads((out / "tables/qa/data_qa.json").read_text())["faults"])


def test_made_defects_are_found(spark):
    df = spark.createDataFrame([("2020-01-01", "a", 1.0), ("2020-01-01", "a", 2.0), ("2021-01-01", "b", None), (None, "c", 1.0)], "date string, code string, x double").withColumn("date", F.to_date("date"))
    rows, faults = qa.year_faults(df, range(2020, 2023), ("date", "code", "volume"), "t")
    assert [r.year for r in rows] == [2020, 2021] and faults == ["t: missing column volume", "t: 1 rows without a key", "t: no row of 2022", "t: 1 keys of 2020 more than once"]
    new = spark.createDataFrame([("2020-01-01", "a", b"\x00\xff", 1.0, 0.5), ("2020-01-01", "b", b"\x00\x00", None, None), ("2020-01-01", "c", b"\x00\x00", 1.0, 0.5)], "date string, code string, image binary, label_5d double, future_ret_5d double")
    old = spark.createDataFrame([("2020-01-01", "a", b"\x05\xff", 1.0, 0.5 + 1e-9), ("2020-01-01", "b", b"\x00\xff", 0.0, None)], new.schema)
    row = qa.compare_images(new, old, 10, (5,)).first()
    assert (row.n_common, row.n_sampled, row.n_pixel_mismatch, row.max_pixel_difference, row.n_value_mismatch) == (2, 2, 2, 255, 1)


def test_command_line(spark, out, monkeypatch):
    args = cli.parser().parse_args(["backtest", "--out", "x", "--max-files", "3", "--table-dir", "t", "--old-data-dir", "o", "--sample-size", "5", "--limit-parts", "2", "--workers", "8"])
    assert (args.max_files, args.table_dir, args.old_data_dir, args.sample_size, args.limit_parts, args.workers) == (3, "t", "o", 5, 2, 8)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["unknown"])
    monkeypatch.setattr(cli, "EngineConfig", lambda: CFG)
    monkeypatch.setattr(cli, "build", lambda: spark)
    cli.main(["logistic", "--out", str(out), "--experiments", "I5R5", "--features", "reversal_5d,vol_20d"])
    rows = read(out / "tables/logistic_metrics.csv")
    assert [r["split"] for r in rows] == ["test", "valid"] and all(0 <= float(r["auc"]) <= 1 for r in rows)
