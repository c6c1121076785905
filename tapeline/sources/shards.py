"""Image shards, folders of ``images.npy`` (bytes of n images of one shape) and ``meta.parquet`` (a row for each), as a source and a sink of Spark.

Reading: the driver lists the shards and reads their headers (of several at once), which tell the shape, the type and the number of images;
with the footer of the metadata these are checked before any image is read, and an error names its shard. Shards are cut
into ranges of rows; a task seeks to its bytes and reads them only. Filters on shard_id and local_index choose shards and
ranges where the session pushes filters to Python sources, and by options in any session.

Writing: each task writes shards of ``rows`` images into a folder of its own; the commit renames them to shard_00000,
shard_00001, ... in order of the tasks, so the target holds whole shards only, and a failed job leaves nothing.

Options: path; height, width (of the images; read from the first shard if not given); first, last (shard numbers to read);
range_bytes (of images in one task, 32 MB); rows (images in a written shard, 10,000).
The file system is any that Arrow knows by the path's scheme.
"""

from __future__ import annotations

import ast
import posixpath
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "image_shards"
#: Columns that the source adds to those of the metadata.
OWN = "shard_id INT, local_index INT, image BINARY"
RANGE_BYTES, ROWS, THREADS, BATCH = 32 << 20, 10_000, 16, 1000


@dataclass
class Header:
    """What the head of an .npy file says."""

    offset: int
    rows: int
    shape: tuple[int, ...]


def read_header(stream, path: str) -> Header:
    """Checks the type and order from the header alone."""
    head = stream.read(10)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path}: no array file")
    wide = head[6] > 1
    size = struct.unpack("<I", head[8:10] + stream.read(2))[0] if wide else struct.unpack("<H", head[8:10])[0]
    said = ast.literal_eval(stream.read(size).decode("utf-8" if head[6] > 2 else "latin-1"))
    if said["descr"] != "|u1" or said["fortran_order"] or len(said["shape"]) != 4 or said["shape"][3] != 1:
        raise ValueError(f"{path}: images must be bytes of shape (n, height, width, 1), not {said['descr']} of {said['shape']}")
    return Header((12 if wide else 10) + size, said["shape"][0], tuple(said["shape"][1:3]))


@dataclass
class Range(InputPartition):
    """Images ``start`` to ``stop`` of one shard, from byte ``offset`` of its file."""

    folder: str
    shard: int
    start: int
    stop: int
    offset: int
    size: int


def _system(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.shards = [int(options.get("first", 0)), int(options.get("last", 1 << 31))]
        self.rows = [0, 1 << 62]

    def _checked(self, fs: pfs.FileSystem, folder: str) -> Header:
        image, meta = f"{folder}/images.npy", f"{folder}/meta.parquet"
        try:
            with fs.open_input_file(image) as f:
                header = read_header(f, image)
            rows = pq.read_metadata(meta, filesystem=fs).num_rows
        except FileNotFoundError as e:
            raise ValueError(f"incomplete image shard {folder}: {e}") from None
        if rows != header.rows:
            raise ValueError(f"{folder}: {header.rows} images, {rows} rows of metadata")
        return header

    def partitions(self) -> list[Range]:
        fs, root = _system(self.options["path"])
        folders = sorted(i.path for i in fs.get_file_info(pfs.FileSelector(root)) if i.type == pfs.FileType.Directory and posixpath.basename(i.path).startswith("shard_"))
        if not folders:
            raise ValueError(f"no image shard under {root}")
        asked = [(k, f) for k, f in enumerate(folders) if self.shards[0] <= k <= self.shards[1]]
        with ThreadPoolExecutor(THREADS) as pool:
            headers = list(pool.map(lambda x: self._checked(fs, x[1]), asked))
        shape = (int(self.options["height"]), int(self.options["width"])) if "height" in self.options else headers[0].shape if headers else None
        out = []
        for (k, folder), h in zip(asked, headers, strict=True):
            if h.shape != shape:
                raise ValueError(f"{folder}: images of shape {h.shape}, not {shape}")
            size = h.shape[0] * h.shape[1]
            step = max(1, int(self.options.get("range_bytes", RANGE_BYTES)) // size)
            low, high = max(0, self.rows[0]), min(h.rows, self.rows[1] + 1)
            out += [Range(folder, k, a, min(a + step, high), h.offset, size) for a in range(low, high, step)]
        return out or [Range("", 0, 0, 0, 0, 0)]  # Spark asks for a partition at least

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        fs, _ = _system(self.options["path"])
        names = self.schema.names
        with fs.open_input_file(f"{part.folder}/meta.parquet") as f:
            have = pq.ParquetFile(f)
            own = [c for c in names if c not in ("shard_id", "local_index", "image")]
            if missing := [c for c in own if c not in have.schema_arrow.names]:
                raise ValueError(f"{part.folder}: metadata lacks {missing}")
            meta = have.read(columns=own).slice(part.start, part.stop - part.start)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with fs.open_input_file(f"{part.folder}/images.npy") as f:
            f.seek(part.offset + part.start * part.size)
            for a in range(part.start, part.stop, BATCH):
                n = min(BATCH, part.stop - a)
                columns = {"shard_id": pa.array(np.full(n, part.shard, np.int32)), "local_index": pa.array(np.arange(a, a + n, dtype=np.int32))}
                if "image" in names:
                    raw = f.read(n * part.size)
                    if len(raw) < n * part.size:
                        raise ValueError(f"{part.folder}: the file ends before image {a + len(raw) // part.size}")
                    ends = np.arange(n + 1, dtype=np.int32) * np.int32(part.size)
                    columns["image"] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                rows = meta.slice(a - part.start, n)
                yield pa.RecordBatch.from_arrays([(columns[c] if c in columns else rows[c].combine_chunks()).cast(schema.field(c).type) for c in names], schema=schema)


class FilteringReader(ShardReader):
    """For sessions that push filters to Python sources; others may not have this method at all."""

    def pushFilters(self, filters):
        bounds = {("shard_id",): self.shards, ("local_index",): self.rows}
        for f in filters:
            of = bounds.get(getattr(f, "attribute", None))
            if of is None or getattr(f, "value", None) is None:
                yield f
            elif isinstance(f, EqualTo):
                of[:] = [max(of[0], f.value), min(of[1], f.value)]
            elif isinstance(f, In) and f.value:
                of[:] = [max(of[0], min(f.value)), min(of[1], max(f.value))]
                yield f  # bounds only
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                of[0] = max(of[0], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                of[1] = min(of[1], f.value - isinstance(f, LessThan))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    folders: list[str]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _system(self.options["path"])
        shape = (int(self.options["height"]), int(self.options["width"]))
        most, held, n, folders = int(self.options.get("rows", ROWS)), [], 0, []
        own = f"{root}/{self.temporary}/{uuid.uuid4().hex}"

        def flush(batches: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(batches)
            image = table["image"].combine_chunks()
            sizes = np.diff(np.frombuffer(image.buffers()[1], np.int32)[image.offset : image.offset + len(image) + 1]) if len(image) else np.zeros(0)
            if image.null_count or (sizes != shape[0] * shape[1]).any():
                raise ValueError(f"images must have {shape[0]} x {shape[1]} bytes")
            folder = f"{own}/{len(folders):05d}"
            fs.create_dir(folder)
            head = repr({"descr": "|u1", "fortran_order": False, "shape": (table.num_rows, *shape, 1)}).encode()
            head += b" " * (-(len(head) + 11) % 64) + b"\n"
            with fs.open_output_stream(f"{folder}/images.npy") as f:
                f.write(b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head)
                at = image.offset
                begin, end = np.frombuffer(image.buffers()[1], np.int32)[[at, at + len(image)]]
                f.write(image.buffers()[2].slice(int(begin), int(end - begin)))
            meta = table.drop_columns([c for c in ("image", "shard_id", "local_index") if c in table.column_names])
            pq.write_table(meta, f"{folder}/meta.parquet", filesystem=fs, compression="zstd")
            folders.append(folder)

        for batch in batches:
            while n + batch.num_rows >= most:
                cut = most - n
                flush([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            flush(held)
        return Written(folders)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _system(self.options["path"])
        fs.create_dir(root)
        old = [i.path for i in fs.get_file_info(pfs.FileSelector(root)) if posixpath.basename(i.path).startswith("shard_")]
        if self.overwrite:
            for path in old:
                fs.delete_dir(path)
        start = 0 if self.overwrite else len(old)
        for k, folder in enumerate(f for m in messages if m for f in m.folders):
            fs.move(folder, f"{root}/shard_{start + k:05d}")
        self._clean(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_system(self.options["path"]))

    def _clean(self, fs: pfs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.temporary}").type == pfs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.temporary}")


class ImageShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return OWN

    def reader(self, schema: StructType) -> ShardReader:
        return (FilteringReader if self.options.get("push") == "true" else ShardReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, schema, overwrite)


def read_shards(spark: SparkSession, path: str, meta: str = "date DATE, code STRING", **options: object) -> DataFrame:
    """Images of a folder of shards with the columns ``meta`` of their metadata."""
    spark.dataSource.register(ImageShards)
    options["push"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).schema(f"{OWN}, {meta}" if meta else OWN).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_shards(df: DataFrame, path: str, height: int, width: int, rows: int = ROWS, overwrite: bool = True) -> None:
    """``df`` (image and metadata columns) as shards; rows stay in the order of their partitions."""
    df.sparkSession.dataSource.register(ImageShards)
    df.write.format(NAME).options(height=str(height), width=str(width), rows=str(rows)).mode("overwrite" if overwrite else "append").save(path)
