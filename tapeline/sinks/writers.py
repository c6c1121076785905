"""Writers: partitioned and bucketed tables, image files, CSV and JSON reports. Overwriting is by whole table or partition.

Tables by year, bucket or code are rebalanced before they are written: large partitions are split and small ones put together by
their real sizes, so one year is no single task, and no file has more than ``file_rows`` rows.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeline.functions.exprs import code_bucket, join_codes
from tapeline.sinks.stored import delete

#: Most rows of one file of a partitioned table.
FILE_ROWS = 2_000_000


def _partitioned(df: DataFrame, path: str, by: str, order: list[str], file_rows: int) -> None:
    spread = df.hint("rebalance", F.col(by)).sortWithinPartitions(by, *order)
    spread.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", file_rows).partitionBy(by).parquet(path)


def by_code(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """One directory for each code."""
    _partitioned(df, path, "code", ["date"], file_rows)


def by_year(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """One directory for each year."""
    _partitioned(df.withColumn("year", F.year("date")), path, "year", ["date", "code"], file_rows)


def by_bucket(df: DataFrame, path: str, buckets: int = 128, file_rows: int = FILE_ROWS) -> None:
    """One directory for each bucket of codes."""
    _partitioned(df.withColumn("bucket", code_bucket(F.col("code"), buckets)), path, "bucket", ["code", "date"], file_rows)


def bucketed_table(df: DataFrame, name: str, buckets: int = 128, path: str | None = None) -> None:
    """A catalog table in buckets of codes, one sorted file each: windows by code and joins on it read it without an exchange."""
    writer = df.repartition(buckets, "code").sortWithinPartitions("code", "date").write.mode("overwrite").format("parquet").bucketBy(buckets, "code").sortBy("code", "date")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def observed(df: DataFrame, write: Callable[[DataFrame], None], years: range) -> dict:
    """What ``write`` writes of ``df``, counted in the writing pass itself: rows, null keys, first and last date, rows of each year.

    The plan of ``write`` must read ``df`` once (no sampling of ranges).
    """
    seen = Observation()
    null = F.col("date").isNull() | F.col("code").isNull()
    each = [F.count_if(F.year("date") == y).alias(f"year_{y}") for y in years]
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("null_keys"), F.min("date").alias("first"), F.max("date").alias("last"), *each))
    return seen.get


def image_shards(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Dense images in files of ``rows`` rows at most, in order of date and code."""
    df.repartitionByRange("date", "code").sortWithinPartitions("date", "code").write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def members(df: DataFrame, path: str) -> None:
    """Member predictions by loss, experiment, fold and seed; only partitions that occur are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("loss", "experiment", "fold", "seed").parquet(path)


def csv_file(df: DataFrame, path: str, append: bool = False) -> None:
    """``df`` as one CSV file with one mark of its encoding and one header, an empty table too; code sets as one text.

    Tasks write parts, and the commit joins them in their order, so the last stage keeps its tasks. The file comes by a rename, so a
    failure leaves what was there before. ``append`` puts the rows behind those of the file, if there is one.
    """
    spark = df.sparkSession
    flat = df.select(*[join_codes(F.col(n)).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes])
    jvm, conf, own = spark._jvm, spark._jsc.hadoopConfiguration(), uuid.uuid4().hex
    at = jvm.org.apache.hadoop.fs.Path
    target, parts, whole = at(path), f"{path}.{own}.parts", f"{path}.{own}.whole"
    fs = target.getFileSystem(conf)
    copy = jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        flat.write.csv(parts)
        found = sorted(x.getPath().getName() for x in fs.listStatus(at(parts)))
        more = append and fs.exists(target)
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(flat.columns)
        out = fs.create(at(whole), True)
        try:
            if not more:
                out.write(bytearray(head.getvalue().encode("utf-8-sig")))
            for x in [target] * more + [at(f"{parts}/{n}") for n in found if n.startswith("part-")]:
                stream = fs.open(x)
                copy(stream, out, 1 << 20, False)
                stream.close()
        finally:
            out.close()
        fs.delete(target, True)
        if not fs.rename(at(whole), target):
            raise OSError(f"can't rename to {path}")
    finally:
        delete(spark, parts)
        delete(spark, whole)


def csv_table(df: DataFrame, path: str, prefix: str = "") -> None:
    """A result table as the file ``path``.csv, with a prefix to its name."""
    head, _, name = path.rpartition("/")
    csv_file(df, f"{head}/{prefix}{name}.csv" if head else f"{prefix}{name}.csv")


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_file(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON file, by a rename."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, part = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), f"{path}.{uuid.uuid4().hex}"
    out = fs.create(at(part), True)
    out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()
    fs.delete(at(path), False)
    if not fs.rename(at(part), at(path)):
        raise OSError(f"can't rename to {path}")
