"""A logistic model of images, which Spark fits itself: the share of lit pixels in bands of rows as features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.config import image_shape
from tapeline.models.logistic import LogisticBaseline


def bands(df: DataFrame, window: int, n: int = 8) -> DataFrame:
    """``df`` with band_0, band_1, ...: the share of lit pixels in ``n`` bands of rows of its ``image``."""
    height, width, _, _ = image_shape(window)
    step = -(-height // n)
    text = F.hex("image")
    cut = lambda b: F.substring(text, 1 + 2 * b * step * width, 2 * step * width)
    return df.withColumns({f"band_{b}": F.length(F.replace(cut(b), F.lit("00"), F.lit(""))) / (2.0 * step * width) for b in range(n)})


def pixel_logistic(n: int = 8, **options) -> LogisticBaseline:
    """The estimator over ``bands``."""
    return LogisticBaseline(features=[f"band_{b}" for b in range(n)], **options)
