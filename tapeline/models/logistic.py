"""Logistic baseline as an Estimator and its Model: exact medians for missing values, population standardisation, L2-regularised fit.

Medians come from sketches and what lies within their bounds (operators.order), all features in one pass, so no task holds a feature's values. The model
is written with its parameters as Spark's own metadata and the inner regression beside them, and read back equal.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.order import described
from tapeline.sinks.stored import Steps

#: The baseline's features, in the order in which the model takes them.
FEATURES = (
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ret_60d",
    "reversal_5d", "reversal_10d", "momentum_20d", "momentum_60d",
    "ma5_gap", "ma10_gap", "ma20_gap", "ma30_gap", "ma60_gap",
    "position_5d", "position_20d", "position_60d",
    "vol_20d", "vol_60d",
    "amount_change_20d", "turnover_change_20d", "log_float_mktcap",
)
MODEL_NAME = "LogisticRaw"


def _number(c: str) -> Column:
    """As a double; NaN counts as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """The exact median of each feature; 0 for one without values."""
    return {c: middle for c, (middle, *_) in filled_moments(df, features)[0].items()}


def filled_moments(df: DataFrame, features: list[str]) -> tuple[dict[str, tuple[float, float, float]], int]:
    """Of each feature its exact median (0 without values), and mean and population deviation after missing values were filled by it; and the number of rows.

    The moments follow from those of the values that are there, so they come from the pass that sketches the medians.
    """
    with Steps():
        rows = df.count()
        found = described(df, [_number(c) for c in features], 0.5).collect()  # a row for each feature
    out = {}
    for r in found:
        middle, missing = r.quantile or 0.0, rows - r.n
        if not r.n or not r.deviation:  # equal values, and the filled ones equal them
            out[features[r.f]] = (middle, middle, 0.0)
            continue
        mean = (r.n * r.mean + missing * middle) / rows
        variance = (r.n * (r.deviation**2 + (r.mean - mean) ** 2) + missing * (middle - mean) ** 2) / rows
        out[features[r.f]] = (middle, mean, variance**0.5)
    return out, rows


class _Parameters(Params):
    features = Param(Params._dummy(), "features", "names of the features", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "name of the label, 0 or 1", TypeConverters.toString)
    inverse_penalty = Param(Params._dummy(), "inverse_penalty", "inverse of the penalty on the summed loss", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "most iterations of the fit", TypeConverters.toInt)


class LogisticBaseline(_Parameters, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on rows with a label; an empty training table is an error."""

    @keyword_only
    def __init__(self, *, features: list[str] | None = None, label: str = "label", inverse_penalty: float = 1.0, iterations: int = 1000):
        super().__init__()
        self._setDefault(features=list(FEATURES), label="label", inverse_penalty=1.0, iterations=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogisticBaselineModel:
        features, label = self.getOrDefault("features"), self.getOrDefault("label")
        train = dataset.where(F.col(label).isNotNull())
        found, rows = filled_moments(train, features)
        if not rows:
            raise ValueError("no row to learn from")
        middle, mean, deviation = zip(*[found[c] for c in features], strict=True)
        model = LogisticBaselineModel()._copy_of(self, list(middle), list(mean), [d or 1.0 for d in deviation])
        # the mean loss takes 1 / (C * rows) of what the summed loss takes 1 / C of
        inner = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=self.getOrDefault("iterations"), regParam=1 / (self.getOrDefault("inverse_penalty") * rows), elasticNetParam=0.0, standardization=False, tol=1e-8)
        model.inner = inner.fit(model.prepared(train))
        return model


class LogisticBaselineModel(_Parameters, Model, MLReadable, MLWritable):
    """Medians, means and deviations of the training rows, and the fitted regression."""

    middle = Param(Params._dummy(), "middle", "medians", TypeConverters.toListFloat)
    mean = Param(Params._dummy(), "mean", "means after filling", TypeConverters.toListFloat)
    deviation = Param(Params._dummy(), "deviation", "population deviations after filling, 1 for constant features", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self.inner: LogisticRegressionModel | None = None

    def _copy_of(self, fitted: _Parameters, middle: list[float], mean: list[float], deviation: list[float]) -> LogisticBaselineModel:
        own = {p.name: fitted.getOrDefault(p.name) for p in fitted.params}
        self._set(**own, middle=middle, mean=mean, deviation=deviation)
        return self

    def scaled(self) -> list[Column]:
        """The filled and standardised features."""
        own = zip(self.getOrDefault("features"), self.getOrDefault("middle"), self.getOrDefault("mean"), self.getOrDefault("deviation"), strict=True)
        return [(F.coalesce(_number(c), F.lit(m)) - mean) / sd for c, m, mean, sd in own]

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector _x of ``scaled``, as the regression is fitted on."""
        scaled = {f"_z{i}": z for i, z in enumerate(self.scaled())}
        return VectorAssembler(inputCols=list(scaled), outputCol="_x").transform(df.withColumns(scaled)).drop(*scaled)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with pred_prob: column arithmetic, which stays in generated code and carries no model to the tasks."""
        weights = self.inner.coefficients.toArray().tolist()
        margin = sum((z * w for z, w in zip(self.scaled(), weights, strict=True)), F.lit(float(self.inner.intercept)))
        return dataset.withColumn("pred_prob", 1 / (1 + F.exp(-margin)))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: LogisticBaselineModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.inner.write().save(f"{path}/regression")


class _Reader(MLReader):
    def load(self, path: str) -> LogisticBaselineModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LogisticBaselineModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.inner = LogisticRegressionModel.load(f"{path}/regression")
        return model
