"""Command line: python -m tapeline.cli STAGE --out DIR [options].

TAPELINE_DATA_DIR and TAPELINE_OUTPUT_DIR stand for --out where it isn't given: the panel, features and images lie in the one,
members, models, predictions and tables in the other (in the same folder, if only one is known).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.plans import pipeline, training
from tapeline.session import build
from tapeline.sources import bars, prices, tables

STAGES = ("panel", "features", "images", "logistic", "members", "aggregate", "backtest", "nonoverlap", "qa")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--out", "--output-dir", dest="out", default=os.environ.get("TAPELINE_OUTPUT_DIR") or os.environ.get("TAPELINE_DATA_DIR"), help="folder of all that stages write")
    p.add_argument("--raw-dir", help="directory of raw price CSV files (panel)")
    p.add_argument("--adjusted-dir", help="directory of adjusted price CSV files (panel)")
    p.add_argument("--encoding", help="of all price files, if known")
    p.add_argument("--data", help="directory of tick tables instead of price files (panel)")
    p.add_argument("--limit-codes", help="codes to keep, with commas (panel)")
    p.add_argument("--limit-parts", type=int, help="so many codes, the first in order (images)")
    p.add_argument("--table", help="catalog table of the panel in buckets of codes, written by panel and read by features")
    p.add_argument("--shards", action="store_true", help="also write images as shards of arrays with their metadata (images)")
    p.add_argument("--experiments", help="names, with commas")
    p.add_argument("--members", help="directory of member predictions by loss, experiment, fold and seed (aggregate)")
    p.add_argument("--loss", default="bce", choices=("bce", "huber", "huber_ic"), help="of the members (members, aggregate)")
    p.add_argument("--expected-members", type=int, help="folds times seeds (aggregate, qa)")
    p.add_argument("--pred-dir")
    p.add_argument("--pred-pattern", default="*")
    p.add_argument("--max-files", type=int, help="so many prediction tables, the first by name (backtest, nonoverlap)")
    p.add_argument("--table-dir", help="folder of result tables, OUT/tables if not given (aggregate, backtest, nonoverlap)")
    p.add_argument("--output-prefix", default="")
    p.add_argument("--features", help="columns of the logistic model, with commas; the baseline's own if not given")
    p.add_argument("--workers", type=int, default=4, help="experiments or members that are trained at once")
    p.add_argument("--old-data-dir", help="folder of an earlier run, whose images are compared (qa)")
    p.add_argument("--sample-size", type=int, default=32, help="images that are compared (qa)")
    p.add_argument("--check-predictions", type=int, metavar="TABLES", help="so many tables of predictions must be there and whole (qa)")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if not a.out:
        raise SystemExit("neither --out nor TAPELINE_OUTPUT_DIR")
    spark, cfg = build(), EngineConfig()
    data = a.out if args or not os.environ.get("TAPELINE_DATA_DIR") else os.environ["TAPELINE_DATA_DIR"]
    columns = a.features.split(",") if a.features else None
    if a.stage == "panel":
        if a.data:
            b = bars.supplier_bars(spark, a.data, by=("code", "date"))
            raw, adjusted = bars.raw_prices(b), bars.adjusted_prices(b)
        else:
            raw = prices.raw_table(spark, a.raw_dir, cfg, a.encoding) if a.raw_dir else None
            adjusted = prices.adjusted_table(spark, a.adjusted_dir, cfg, a.encoding) if a.adjusted_dir else None
        keep = a.limit_codes.split(",") if a.limit_codes else None
        raw, adjusted = (df.where(F.col("code").isin(keep)) if keep and df is not None else df for df in (raw, adjusted))
        pipeline.build_panel(raw, adjusted, cfg, data, a.table)
    elif a.stage == "features":
        pipeline.build_features(spark, cfg, data, a.table)
    elif a.stage == "images":
        pipeline.build_images(spark, cfg, data, a.experiments, a.limit_parts, a.shards)
    elif a.stage == "logistic":
        training.train_logistic(spark, cfg, a.out, columns, a.experiments, a.workers)
    elif a.stage == "members":
        for e in cfg.select(a.experiments):
            training.train_members(spark, cfg, a.out, e, loss=a.loss, columns=columns, workers=a.workers)
    elif a.stage == "aggregate":
        pipeline.aggregate_all(spark, a.members or f"{a.out}/members/predictions", a.loss, cfg, a.out, a.experiments, a.table_dir, a.expected_members)
    elif a.stage == "qa":
        pipeline.check_quality(spark, cfg, a.out, a.old_data_dir, a.sample_size, a.check_predictions, a.expected_members)
    else:
        pred = tables.read_predictions(spark, a.pred_dir or f"{a.out}/predictions", a.pred_pattern, a.max_files)
        daily = tables.read_daily(spark, f"{data}/features_by_year", tables.earliest_date(pred))
        pipeline.evaluate(pred, daily, cfg, a.out, a.stage == "backtest", a.output_prefix, a.table_dir)


if __name__ == "__main__":
    main()
