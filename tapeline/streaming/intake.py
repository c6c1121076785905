"""Intake of prediction files as they come: each file once, whatever is stopped in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.cross_section import predictions
from tapeline.schema import PREDICTION, require_columns


def take_in(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str, pattern: str = "pred_*.parquet", max_files: int | None = None) -> int:
    """Adds the files of ``path`` that are new to the table ``out``, in their common form, and ends; the number of batches it took.

    Each batch is a partition of ``out`` by the stream's own number and is written over, not added: a batch that was written
    when the run was stopped, before the checkpoint knew it, is written again with the same files. ``max_files`` bounds a batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = predictions(require_columns(batch, PREDICTION, "predictions")).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = reader.parquet(path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
