"""Price files: one CSV for each stock, in one of several encodings, and their directories."""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import EngineConfig
from tapeline.operators import panel
from tapeline.sinks.stored import stored

#: A catalogue of files up to this many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES, FILE_BYTES = 16 << 20, 1024
#: The mark of UTF-8 at a file's beginning.
MARK = b"\xef\xbb\xbf"

#: The encodings that are tried in turn.
ENCODINGS = ("gbk", "utf-8-sig", "utf-8", "gb18030")

#: Headers of a raw price file and the panel's names, in the files' order.
RAW_HEADERS = {
    "日期": "date", "代码": "code", "名称": "name", "所属行业": "industry",
    "开盘价": "open_raw", "最高价": "high_raw", "最低价": "low_raw", "收盘价": "close_raw", "前收盘价": "prev_close_raw",
    "成交量（股）": "volume", "成交额（元）": "amount", "换手率": "turnover_rate", "涨幅%": "pct_chg", "振幅%": "amplitude", "是否ST": "is_st", "量比": "volume_ratio",
    "3日涨幅%": "ret_3d_raw", "6日涨幅%": "ret_6d_raw", "10日涨幅%": "ret_10d_raw", "25日涨幅%": "ret_25d_raw", "是否涨停": "is_limit_up",
    "总股本（股）": "total_shares", "流通股本（股）": "float_shares", "总市值（元）": "total_mktcap", "流通市值（元）": "float_mktcap",
    "滚动市盈率": "pe_ttm", "市净率": "pb", "滚动市销率": "ps_ttm", "上市时间": "list_date", "退市时间": "delist_date",
}
#: The same of an adjusted price file.
ADJUSTED_HEADERS = {"日期": "date", "代码": "code", "开盘价": "open_adj", "最高价": "high_adj", "最低价": "low_adj", "收盘价": "close_adj"}
_FLAGS, _DAYS, _TEXTS = ["is_st", "is_limit_up"], ["list_date", "delist_date"], {"date", "code", "name", "industry"}


def raw_table(spark: SparkSession, path: str, cfg: EngineConfig, encoding: str | None = None) -> DataFrame:
    """The cleaned raw prices of a directory."""
    numbers = [c for c in RAW_HEADERS.values() if c not in {*_TEXTS, *_FLAGS, *_DAYS}]
    return read_prices(spark, path, RAW_HEADERS, numbers, _FLAGS, _DAYS, cfg, encoding)


def adjusted_table(spark: SparkSession, path: str, cfg: EngineConfig, encoding: str | None = None) -> DataFrame:
    """The cleaned adjusted prices of a directory."""
    return read_prices(spark, path, ADJUSTED_HEADERS, [c for c in ADJUSTED_HEADERS.values() if c not in _TEXTS], [], [], cfg, encoding)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether the row's split is the file's first one) and the bytes of each line of the CSV files under ``path``.

    In all ENCODINGS a line's end is a byte that no other character holds, so files are cut between lines before it is known
    how to read them, and a file of any size is read by many tasks. The reader drops a mark of UTF-8 at a file's beginning.
    """
    df = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    at = F.col("_metadata")
    return df.select(at["file_path"].alias("file"), at["file_size"].alias("size"), (at["file_block_start"] == 0).alias("first"), F.col("value").cast("binary").alias("line"))


def catalogue(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """file, head (the bytes of its first line), mark and encoding, the first that reads all its lines (null: none does); one pass over bytes.

    A file has a mark of UTF-8 if it is longer than its lines are; with its mark, a first line must be read as well.
    """

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            files, raw = batch.column("file").to_pylist(), batch.column("line").to_pylist()
            rows = []
            for b, e in _runs(files):
                data = b"\n".join(raw[b:e])
                head = raw[b] if batch.column("first")[b].as_py() and files[b] != last else None
                rows.append({"file": files[b], "size": batch.column("size")[b].as_py(), "head": head, "bytes": len(data) + 1, "reads": [_reads(data, x) for x in encodings]})
                last = files[b]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("bytes", pa.int64()), ("reads", pa.list_(pa.bool_()))]))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mark = r["size"] - r["bytes"] > 1  # the last line may lack its end
                fits = [x for x, ok in zip(encodings, r["reads"], strict=True) if ok and (not mark or _reads(MARK + (r["head"] or b""), x))]
                rows.append({"file": r["file"], "head": r["head"], "mark": mark, "encoding": fits[0] if fits else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("head", pa.binary()), ("mark", pa.bool_()), ("encoding", pa.string())]))

    each = lines(spark, path).mapInArrow(tried, "file string, size long, head binary, bytes long, reads array<boolean>")
    all_read = F.array(*[F.min(F.col("reads")[k]) for k in range(len(encodings))])
    known = each.groupBy("file", "size").agg(F.max("head").alias("head"), F.sum("bytes").alias("bytes"), all_read.alias("reads"))
    return known.mapInArrow(settled, "file string, head binary, mark boolean, encoding string")


def _runs(files: list[str]) -> list[tuple[int, int]]:
    """Beginnings and ends of runs of one file."""
    starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
    return list(zip(starts, [*starts[1:], len(files)], strict=True))


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def read_csv_files(spark: SparkSession, path: str, columns: list[str], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """``columns`` of all CSV files under ``path``, as text, with ``file_stem``; each file in the first encoding that reads it.

    A first pass makes the catalogue of files, which is written as a step; the second reads each line by its file's encoding and
    header. A record is a line. Columns that a file lacks are null; blank lines and empty files have no rows; a file that no encoding reads
    is an error.
    """
    known = stored(catalogue(spark, path, encodings))
    n = known.count()
    if bad := known.where("encoding is null").head(1):
        raise ValueError(f"no encoding reads {bad[0].file}")
    schema = pa.schema([(c, pa.string()) for c in (*columns, "file_stem")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            files = batch.column("file").to_pylist()
            for b, e in _runs(files):
                encoding, head = batch.column("encoding")[b].as_py(), batch.column("head")[b].as_py()
                own = batch.column("line").slice(b, e - b).to_pylist()
                if batch.column("first")[b].as_py() and files[b] != last:
                    own = own[1:]
                last = files[b]
                if not head or not head.strip():
                    continue
                head = MARK + head if batch.column("mark")[b].as_py() else head
                text = [head.decode(encoding).rstrip("\r"), *[x.decode(encoding).rstrip("\r") for x in own if x.strip()]]
                if len(text) == 1:
                    continue
                names = text[0].split(",")
                options = pc.ConvertOptions(column_types={h.strip('"'): pa.string() for h in names}, strings_can_be_null=False)
                table = pc.read_csv(pa.BufferReader("\n".join(text).encode()), convert_options=options)
                rows, stem = table.num_rows, files[b].rsplit("/", 1)[-1].rsplit(".", 1)[0]
                cols = [table[c].combine_chunks() if c in table.column_names else pa.nulls(rows, pa.string()) for c in columns]
                yield from pa.Table.from_arrays([*cols, pa.array([urllib.parse.unquote(stem)] * rows, pa.string())], schema=schema).to_batches()

    raw = lines(spark, path)
    both = raw.join(F.broadcast(known) if n * FILE_BYTES <= BROADCAST_BYTES else known, "file")
    # by a shuffle, lines of a file are no longer in its order: its header is told by its bytes, then
    if n * FILE_BYTES > BROADCAST_BYTES:
        both = both.where(~(F.col("line") == F.col("head"))).withColumn("first", F.lit(False))
    return both.select("file", "first", "line", "head", "mark", "encoding").mapInArrow(decode, ", ".join(f"`{c}` string" for c in (*columns, "file_stem")))


def read_prices(spark: SparkSession, path: str, names: dict[str, str], numbers: list[str], flags: list[str], days: list[str], cfg: EngineConfig, encoding: str | None = None) -> DataFrame:
    """A cleaned price table of a directory. With one known ``encoding`` Spark's own reader splits large files."""
    if encoding:
        df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    else:
        df = read_csv_files(spark, path, list(names))
    return panel.in_range(panel.clean(df, names, numbers, flags, days), cfg)


def stems(df: DataFrame) -> DataFrame:
    """Distinct codes by file name."""
    return df.select(F.col("file_stem").alias("code")).distinct()
