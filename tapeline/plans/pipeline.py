"""Stages over stored tables: panel, features, images, scores, evaluation, quality. Each overwrites its own output."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import EngineConfig, image_shape
from tapeline.operators import cross_section, features, images, panel, performance, portfolio, qa, targets
from tapeline.sinks import writers
from tapeline.sinks.stored import Steps, stored
from tapeline.sources import shards, tables


KEYS = ("date", "code")
#: What the panel must have.
PANEL_QA = (*KEYS, "open_raw", "high_raw", "low_raw", "close_raw", "volume")


def build_panel(raw: DataFrame | None, adjusted: DataFrame | None, cfg: EngineConfig, out: str, table: str | None = None) -> dict:
    """The stored panel, by year and, with ``table``, as a catalog table in buckets of codes; what was written, counted as it was.

    Keys that aren't unique in a price table are an error.
    """
    built = panel.to_storage(panel.build_panel(raw, adjusted, cfg, check=True))
    found = writers.observed(built, lambda df: writers.by_year(df, f"{out}/panel_by_year"), range(cfg.start.year, cfg.end.year + 1))
    if table:
        writers.bucketed_table(built.sparkSession.read.parquet(f"{out}/panel_by_year").drop("year"), table, path=f"{out}/panel_by_code")
    return found


def build_features(spark: SparkSession, cfg: EngineConfig, out: str, table: str | None = None) -> dict:
    """The stored features, from the panel by year or from the catalog table, whose buckets need no exchange before the windows."""
    source = spark.table(table) if table else spark.read.parquet(f"{out}/panel_by_year").drop("year")
    f = features.to_storage(features.build_features(source, cfg), cfg)
    return writers.observed(f, lambda df: writers.by_year(df, f"{out}/features_by_year"), range(cfg.start.year, cfg.end.year + 1))


def build_images(spark: SparkSession, cfg: EngineConfig, out: str, experiments: str | None = None, codes: int | None = None, as_shards: bool = False) -> None:
    """Images of each window as a table and, with ``as_shards``, as array shards; ``codes`` keeps so many, the first in order."""
    f = spark.read.parquet(f"{out}/features_by_year")
    if codes is not None:
        f = f.join(F.broadcast(f.select("code").distinct().orderBy("code").limit(codes)), "code", "left_semi")
    for window in sorted({e.window for e in cfg.select(experiments)}):
        height, width, *_ = image_shape(window, cfg.day_width)
        path = f"{out}/images/window={window}"
        writers.image_shards(images.drawn(images.windows(f, window, cfg), window, cfg), path)
        if as_shards:
            shards.write_shards(spark.read.parquet(path), f"{out}/shards/window_{window}", height, width)


def evaluate(pred: DataFrame, daily: DataFrame, cfg: EngineConfig, out: str, overlapping: bool = True, prefix: str = "", table_dir: str | None = None) -> None:
    """All result tables of one kind of portfolio; the steps made for them, and no others, are deleted at the end."""
    with Steps():
        _evaluate(pred, daily, cfg, table_dir or f"{out}/tables", overlapping, prefix)


def _evaluate(pred: DataFrame, daily: DataFrame, cfg: EngineConfig, out: str, overlapping: bool, prefix: str) -> None:
    ranked = stored(cross_section.universe_deciles(pred, cfg.deciles))
    ic = cross_section.ic_by_period(ranked)
    returns = cross_section.decile_returns(ranked)
    summary = cross_section.decile_summary(returns)
    market = portfolio.placed(daily)  # for all books
    if said := portfolio.warned(portfolio.compounding_check(pred, market), cfg.check_tolerance):
        warnings.warn(said, stacklevel=3)
    days = performance.with_costs(portfolio.portfolio_days(ranked, market, cfg, overlapping), cfg)
    net = performance.long_short(days) if overlapping else performance.with_costs(portfolio.long_short_days(ranked, market), cfg)
    days = stored(days.unionByName(net, allowMissingColumns=True))
    performed = performance.performance(days, cfg)
    results = {
        "ic_by_period": ic, "ic_summary": cross_section.ic_summary(ic), "cumulative_ic": cross_section.cumulative_ic(ic), "decile_returns": returns, "decile_summary": summary, "decile_monotonicity": cross_section.monotonicity(summary),
        "portfolio_returns": days, "portfolio_turnover": days.where("cost_bps = 0").drop("cost_bps"), "portfolio_nav": performance.nav(days), "performance_summary": performed, "return_attribution": performance.attribution(days, cfg), "cost_sensitivity": performance.cost_sensitivity(performed),
    }
    if not overlapping:
        held = stored(portfolio.holdings(ranked, market))
        overlap = portfolio.holding_overlap(held)
        top = f"d{cfg.deciles}_long_only"
        own = [df.where(F.col("portfolio_name") == f"D{cfg.deciles}") for df in (days, results["portfolio_nav"], performed)]
        results |= dict(zip([f"{top}_returns", f"{top}_nav", f"{top}_performance"], own, strict=True))
        results |= {"portfolio_holdings": held, "holding_overlap": overlap, "holding_overlap_summary": portfolio.overlap_summary(overlap)}
    for name, df in results.items():
        writers.csv_table(df, f"{out}/{name}", prefix or ("" if overlapping else "nonoverlap_"))


def aggregate(spark: SparkSession, path: str, loss: str, experiment: str, out: str, score: str = "pred_score_raw", probability: str = "pred_probability", folds: int = 5, seeds: int = 4) -> dict:
    """One prediction table of a loss and experiment: the mean of its members' scores, each standardised within its date; its summary.

    A member without spread or with a missing score on some date, and keys that not all members have, are an error.
    """
    with Steps():
        members = stored(tables.read_members(spark, path, loss, experiment, folds, seeds).withColumnRenamed(probability, "probability"))
        own = ["date", "fold", "seed"]
        if bad := targets.degenerate_members(members, score, own).head(1):
            raise ValueError(f"scores that can't be standardised: {bad[0]}")
        if bad := members.where(F.col("probability").isNull() | F.isnan("probability")).head(1):
            raise ValueError(f"probabilities that are missing: {bad[0]}")
        if short := members.groupBy("date", "code").count().where(F.col("count") != folds * seeds).head(1):
            raise ValueError(f"not one row of each member: {short[0]}")
        carried = ("industry", "future_ret", "label", "amount", "float_mktcap", "is_low_volume_limit_up", "is_low_volume_limit_down", "window", "horizon")
        facts = members.groupBy("date", "code").agg(*[F.min_by(c, F.struct("fold", "seed")).alias(c) for c in carried if c in members.columns])
        merged = targets.ensemble(targets.member_zscore(members, score, own), folds * seeds).join(facts, ["date", "code"])
        name = f"cnn_{loss}_k{folds}s{seeds}"
        merged = merged.withColumns({"experiment_name": F.lit(experiment), "model_name": F.lit(name), "loss_name": F.lit(loss), "pred_prob": F.col("pred_score"), "ensemble_fold_count": F.lit(folds), "ensemble_seed_count": F.lit(seeds)})
        target = f"{out}/predictions/{experiment}_{loss}"
        merged.write.mode("overwrite").parquet(target)
    made = spark.read.parquet(target)
    row = made.agg(F.count("*").alias("rows"), F.countDistinct("date").alias("n_dates"), F.min("date").cast("string").alias("date_start"), F.max("date").cast("string").alias("date_end"), F.avg("pred_score").alias("score_mean"), F.stddev_pop("pred_score").alias("score_std")).first()
    return {"loss_name": loss, "experiment_name": experiment, "model_name": name, "member_count": folds * seeds, **row.asDict(), "prediction_path": target}


def aggregate_all(spark: SparkSession, path: str, loss: str, cfg: EngineConfig, out: str, experiments: str | None = None, table_dir: str | None = None, expected: int | None = None, **options) -> list[dict]:
    """All experiments of a loss, and the table of their summaries; ``expected`` is the number of members that folds and seeds must give."""
    folds, seeds = options.get("folds", 5), options.get("seeds", 4)
    if expected is not None and expected != folds * seeds:
        raise ValueError(f"{expected} members expected, but {folds} folds of {seeds} seeds")
    rows = [aggregate(spark, path, loss, e.name, out, **options) for e in cfg.select(experiments)]
    schema = "loss_name string, experiment_name string, model_name string, member_count int, rows long, n_dates long, date_start string, date_end string, score_mean double, score_std double, prediction_path string"
    writers.csv_table(spark.createDataFrame([tuple(r.values()) for r in rows], schema), f"{table_dir or f'{out}/tables'}/ensemble/cnn_ensemble_summary_{loss}")
    return rows


def check_quality(spark: SparkSession, cfg: EngineConfig, out: str, old: str | None = None, sample: int = 32, predicted: int | None = None, members: int | None = None, years: range | None = None) -> dict:
    """The report of all parts: panel and features by year, images, sampled images against those under ``old``, and ``predicted`` tables of predictions.

    The report is written to tables/qa/data_qa.json, faults and all; then any fault is an error.
    """
    years = years or range(cfg.start.year, cfg.end.year + 1)
    report, faults = {"images": {}, "old_comparison": {}}, []
    needed = {"panel_by_year": PANEL_QA, "features_by_year": (*KEYS, *[f"{p}_{h}d" for h in cfg.horizons for p in ("future_ret", "label")])}
    for name, required in needed.items():
        rows, wrong = qa.year_faults(spark.read.parquet(f"{out}/{name}").drop("year"), years, required, name)
        report[name], faults = [r.asDict() for r in rows], faults + wrong
    for window in cfg.windows:
        path = f"{out}/images/window={window}"
        if not tables.exists(spark, path):
            continue
        height, width, *_ = image_shape(window, cfg.day_width)
        df, horizons = spark.read.parquet(path), cfg.horizons_of_window(window)
        row = qa.images(df, height, width, horizons).first()
        faults += qa.image_faults(row, (cfg.start, cfg.end), f"window {window}")
        report["images"][window] = row.asDict() | {"labels": [r.asDict() for r in qa.label_stats(df, horizons, cfg.end).collect()]}
        if old:
            row = qa.compare_images(df, spark.read.parquet(f"{old}/images/window={window}"), sample, horizons).first()
            report["old_comparison"][window] = row.asDict()
            faults += [f"window {window}: no key in common with the old images"] if not row.n_common else []
    if predicted is not None:
        found = qa.predictions(tables.read_tables(spark, f"{out}/predictions").withColumn("score", F.col("pred_score").cast("double"))).collect()
        report["predictions"] = [r.asDict() for r in found]
        faults += [f"{len(found)} tables of predictions, not {predicted}"] if len(found) != predicted else []
        for r in found:
            name = f"{r.experiment_name}, {r.model_name}"
            faults += [f"{name}: {r.n_duplicate_keys} keys more than once"] if r.n_duplicate_keys else []
            faults += [f"{name}: {r.n_missing_scores} scores that aren't finite"] if r.n_missing_scores else []
            faults += [f"{name}: {r.min_members} to {r.max_members} members, not {members}"] if members and (r.min_members, r.max_members) != (members, members) else []
    report["faults"] = faults
    writers.json_file(spark, report, f"{out}/tables/qa/data_qa.json")
    if faults:
        raise ValueError("; ".join(faults))
    return report
