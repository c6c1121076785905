"""Training stages: the logistic baseline of each experiment, and members of an ensemble by fold and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import EngineConfig, Experiment
from tapeline.functions.exprs import clipped_sigmoid
from tapeline.models.logistic import FEATURES, MODEL_NAME, LogisticBaseline
from tapeline.models.members import Member, Store
from tapeline.operators import features, metrics, targets
from tapeline.plans.concurrent import at_once
from tapeline.sinks import writers
from tapeline.sinks.stored import Steps, stored

#: What predictions carry of the features, in their order, where it is there.
CARRIED = ("date", "code", "industry", "future_ret", "label", "is_tradable", "amount", "float_mktcap", "is_low_volume_limit_up", "is_low_volume_limit_down")


def sample_of(f: DataFrame, e: Experiment) -> DataFrame:
    """Rows that an experiment may learn from: tradable, label and return known, the average over its window known."""
    needed = [c for c in [f"ma{e.window}_adj"] if c in f.columns]
    return features.experiment_view(features.sample_mask(f, e.horizon, needed), e.horizon)


def counted_splits(split: DataFrame, name: str, also: list[str] = []) -> dict[str, int]:  # noqa: B006
    """Rows of train, valid and test; an empty one is an error that tells all three."""
    found = {r.split: r["count"] for r in split.groupBy("split").count().collect() if r.split}
    counts = {k: found.get(k, 0) for k in ("train", "valid", "test")}
    if not all(counts.values()):
        raise ValueError(f"{name}: a split is empty: {counts}")
    return counts


def named(pred: DataFrame, e: Experiment, model: str) -> DataFrame:
    own = {"experiment_name": F.lit(e.name), "window": F.lit(e.window), "horizon": F.lit(e.horizon), "model_name": F.lit(model)}
    return pred.withColumns(own)


def logistic_experiment(f: DataFrame, e: Experiment, cfg: EngineConfig, out: str, columns: list[str]) -> list[dict]:
    """Fit, metrics of valid and test rows, the stored model and the test predictions of one experiment."""
    with Steps():
        split = stored(targets.fixed_split(sample_of(f, e), e.horizon, cfg).where("split is not null"))
        counts = counted_splits(split, e.name)
        model = LogisticBaseline(features=columns).fit(split.where("split = 'train'"))
        model.write().overwrite().save(f"{out}/models/{e.name.lower()}_logistic")
        scored = stored(model.transform(split.where("split <> 'train'")))
        found = metrics.binary_metrics(scored, ["split"], "pred_prob").collect()  # two rows
        keep = [c for c in CARRIED if c in scored.columns]
        pred = named(scored.where("split = 'test'").select(*keep, "pred_prob"), e, MODEL_NAME)
        pred.write.mode("overwrite").parquet(f"{out}/predictions/pred_{e.name.lower()}_logistic.parquet")
    return [{"experiment_name": e.name, "split": r.split, "n": r.n, "train_rows": counts["train"], "auc": r.auc, "accuracy": r.accuracy, "brier": r.brier} for r in found]


def train_logistic(spark: SparkSession, cfg: EngineConfig, out: str, columns: list[str] | None = None, experiments: str | None = None, workers: int = 4) -> list[dict]:
    """All experiments, ``workers`` at a time; their metrics, which also become the table logistic_metrics. One failure stops the others."""
    f = spark.read.parquet(f"{out}/features_by_year")
    wanted = [c for c in columns or FEATURES if columns or c in f.columns]
    tasks = {e.name: (lambda e=e: logistic_experiment(f, e, cfg, out, wanted)) for e in cfg.select(experiments)}
    rows = [r for name, found in sorted(at_once(spark, tasks, workers).items()) for r in sorted(found, key=lambda r: r["split"])]
    schema = "experiment_name string, split string, n long, train_rows long, auc double, accuracy double, brier double"
    writers.csv_table(spark.createDataFrame([tuple(r.values()) for r in rows], schema), f"{out}/tables/logistic_metrics")
    return rows


def bagged(df: DataFrame, seed: int, share: float = 0.8) -> DataFrame:
    """A seeded share of the rows, the same whatever their partitions: rows are chosen by a hash of seed, date and code."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), "date", "code"), F.lit(1_000_000)) < int(share * 1_000_000))


def train_members(spark: SparkSession, cfg: EngineConfig, out: str, e: Experiment, seeds: tuple[int, ...] = (1, 2, 3, 4), loss: str = "bce", columns: list[str] | None = None, workers: int = 4) -> list[dict]:
    """The manifests of all members of an experiment: a logistic model for each fold and seed, scored on the test rows.

    A fold's dates are its valid rows, those within the purge distance are left out, and a seed's rows are a bag of the rest.
    Members that are finished are not trained again.
    """
    f = spark.read.parquet(f"{out}/features_by_year")
    store = Store(spark, f"{out}/members")
    wanted = [c for c in columns or FEATURES if columns or c in f.columns]
    with Steps():
        one = sample_of(f, e)
        # fold k from 1, as in the members' names; only missing members read the split
        split = targets.purged_folds(one, targets.calendar(one), cfg).where("split is not null").withColumn("fold", F.col("fold") + 1)
        members = [Member(loss, e.name, fold, seed) for fold in range(1, cfg.folds + 1) for seed in seeds]
        missing = [m for m in members if not store.manifest(m)]
        if missing:
            split = stored(split)
        at_once(spark, {f"{m.fold}-{m.seed}": (lambda m=m: _member(store, m, split, e, wanted)) for m in missing}, workers)
    return [store.manifest(m) for m in members]


def _member(store: Store, m: Member, split: DataFrame, e: Experiment, columns: list[str]) -> dict:
    def make():
        own = split.where(F.col("fold") == m.fold)
        counts = counted_splits(own, f"{m.experiment}, fold {m.fold}")
        model = LogisticBaseline(features=columns).fit(bagged(own.where("split = 'train'"), m.seed))
        scored = model.transform(own.where("split <> 'train'"))
        p = F.least(F.greatest("pred_prob", F.lit(1e-12)), F.lit(1 - 1e-12))
        scored = scored.withColumn("pred_score_raw", F.ln(p / (1 - p))).withColumn("pred_probability", clipped_sigmoid(F.col("pred_score_raw")))
        with Steps():
            valid = metrics.binary_metrics(scored.where("split = 'valid'"), ["split"], "pred_prob").first()
        keep = [c for c in CARRIED if c in scored.columns]
        pred = scored.where("split = 'test'").select(*keep, F.lit(e.window).alias("window"), F.lit(e.horizon).alias("horizon"), "pred_score_raw", "pred_probability")
        return model, pred, {**{f"{k}_rows": v for k, v in counts.items()}, "valid_auc": valid.auc, "valid_brier": valid.brier}

    return store.trained(m, make)
