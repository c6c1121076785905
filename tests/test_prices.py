"""Price files of unknown encodings: cut between lines, read by many tasks, equal to reading each whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tapeline.sources import prices

COLUMNS = ["日期", "代码", "名称", "所属行业"]


def put(path, encoding, rows, head=("日期", "代码", "名称"), end="\n", blank=False):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(head)
    w.writerows(rows)
    path.write_bytes((out.getvalue() + (end if blank else "")).encode(encoding))


def made(n, names, seed=1):
    rng = random.Random(seed)
    return [(f"2020-01-{k % 28 + 1:02d}", f"{k % 1000:06d}", rng.choice(names)) for k in range(n)]


@pytest.fixture
def folder(tmp_path):
    common = ["平安银行", "万科A, B", 'ST "深"', "", "nan", "x"]
    put(tmp_path / "000001.csv", "gbk", made(300, common), end="\r\n")
    put(tmp_path / "000002.csv", "utf-8", made(200, ["plain ascii", "é"]), blank=True)
    put(tmp_path / "000003.csv", "gb18030", made(500, [*common, "𠮷野家", "한국"]))  # four bytes, which gbk lacks
    put(tmp_path / "000004.csv", "utf-8-sig", made(50, ["ü", "𠮷"]), head=("名称", "日期", "代码"))
    (tmp_path / "000005.csv").write_bytes(b"")
    put(tmp_path / "000006.csv", "gbk", [])
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub/000 007.csv", "gbk", made(5, common))
    return tmp_path


def whole(path):
    """Each file decoded whole by the first encoding that reads it."""
    out = []
    for p in sorted(path.rglob("*.csv")):
        for encoding in prices.ENCODINGS:
            try:
                text = p.read_bytes().decode(encoding)
                break
            except UnicodeDecodeError:
                continue
        for r in csv.DictReader(io.StringIO(text)):
            out.append((*[r.get(c) for c in COLUMNS], p.stem))
    return sorted(out, key=str)


def found(spark, path):
    return sorted(map(tuple, prices.read_csv_files(spark, str(path), COLUMNS).collect()), key=str)


def test_small_files_read_as_whole_ones(spark, folder):
    want = whole(folder)
    assert len(want) == 1055 and found(spark, folder) == want
    kinds = {r.file.rsplit("/", 1)[-1]: r.encoding for r in prices.catalogue(spark, str(folder)).collect()}
    assert kinds["000001.csv"] == "gbk" and kinds["000003.csv"] == "gb18030" and kinds["000004.csv"] in prices.ENCODINGS


def test_a_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    put(tmp_path / "big.csv", "gb18030", made(40_000, ["平安银行", "𠮷野家有限公司", "한국"]))
    want = whole(tmp_path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = prices.read_csv_files(spark, str(tmp_path), COLUMNS)
        assert df.rdd.getNumPartitions() >= 10
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 10
        assert found(spark, tmp_path) == want
        monkeypatch.setattr(prices, "BROADCAST_BYTES", 0)
        assert found(spark, tmp_path) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_many_files_by_a_shuffle(spark, folder, monkeypatch):
    monkeypatch.setattr(prices, "BROADCAST_BYTES", 0)
    assert found(spark, folder) == whole(folder)


def test_no_encoding_reads_it(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes("日期,代码\n".encode("utf-8") + b"\xff\xff\x00\x81\n")
    with pytest.raises(ValueError, match="no encoding reads .*bad.csv"):
        prices.read_csv_files(spark, str(tmp_path), COLUMNS)
