"""Image shards: equal pixels back, only asked ranges read, errors that name the shard, nothing left by a failed write."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapeline.sources import shards

META = "date DATE, code STRING, label_5d DOUBLE"


def put(folder, n, shape=(2, 3), value=0, dtype=np.uint8, rows=None):
    folder.mkdir(parents=True)
    images = (np.arange(n * shape[0] * shape[1]) % 7 + value).reshape(n, *shape, 1).astype(dtype)
    np.save(folder / "images.npy", images)
    m = n if rows is None else rows
    pq.write_table(pa.table({"date": pa.array([dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(m)], pa.date32()), "code": [f"{i:06d}" for i in range(m)], "label_5d": pa.array([None if i % 3 == 0 else float(i % 2) for i in range(m)], pa.float64()), "extra": list(range(m))}), folder / "meta.parquet")
    return images


def test_shards_of_numpy_are_read_in_ranges(spark, tmp_path):
    made = [put(tmp_path / f"shard_{k:05d}", n, value=10 * k) for k, n in enumerate((5, 1, 12))]
    df = shards.read_shards(spark, str(tmp_path), META, range_bytes=6 * 4)
    assert df.rdd.getNumPartitions() == 2 + 1 + 3
    found = {(r.shard_id, r.local_index): r for r in df.collect()}
    assert len(found) == 18
    for k, images in enumerate(made):
        for i, image in enumerate(images):
            r = found[k, i]
            assert bytes(r.image) == image.tobytes() and r.code == f"{i:06d}" and r.date == dt.date(2020, 1, 1) + dt.timedelta(days=i) and r.label_5d == (None if i % 3 == 0 else float(i % 2))
    assert df.select("code").distinct().count() == 12
    assert shards.read_shards(spark, str(tmp_path), "").agg(F.sum(F.length("image"))).first()[0] == 18 * 6


def test_only_asked_ranges_are_read(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"shard_{k:05d}", 8)
    broken = tmp_path / "shard_00002/images.npy"
    broken.write_bytes(broken.read_bytes()[: 128 + 6 * 5])  # its header is whole, its last images aren't
    asked = shards.read_shards(spark, str(tmp_path), META, range_bytes=6 * 2, first=0, last=1)
    assert asked.count() == 16 and {r.shard_id for r in asked.select("shard_id").distinct().collect()} == {0, 1}
    with pytest.raises(Exception, match="shard_00002.*ends before image 4|shard_00002.*ends before"):
        shards.read_shards(spark, str(tmp_path), META, first=2).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = shards.read_shards(spark, str(tmp_path), META, range_bytes=6 * 2).where("shard_id = 2 and local_index < 4 and code <> '000001'")
        assert sorted(r.local_index for r in some.collect()) == [0, 2, 3]
        assert shards.read_shards(spark, str(tmp_path), META).where("shard_id > 5").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("wrong", "message"), [({"shape": (3, 3)}, "shape"), ({"dtype": np.float32}, "bytes of shape"), ({"rows": 3}, "4 images, 3 rows")])
def test_errors_name_the_shard(spark, tmp_path, wrong, message):
    put(tmp_path / "shard_00000", 4)
    put(tmp_path / "shard_00001", 4, **wrong)
    with pytest.raises(Exception, match=f"shard_00001.*{message}"):
        shards.read_shards(spark, str(tmp_path), META).count()


def test_incomplete_shards_and_none(spark, tmp_path):
    with pytest.raises(Exception, match="no image shard"):
        shards.read_shards(spark, str(tmp_path), META).count()
    put(tmp_path / "shard_00000", 4)
    (tmp_path / "shard_00000/meta.parquet").unlink()
    with pytest.raises(Exception, match="incomplete image shard.*shard_00000"):
        shards.read_shards(spark, str(tmp_path), META).count()


def test_written_shards_are_numpys(spark, tmp_path):
    rows = [(dt.date(2021, 1, 1), f"{i:06d}", bytes([i % 256] * 6), float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "date DATE, code STRING, image BINARY, label_5d DOUBLE").repartitionByRange(3, "code").sortWithinPartitions("code")
    shards.write_shards(df, str(tmp_path / "out"), 2, 3, rows=4)
    folders = sorted((tmp_path / "out").iterdir())
    assert [f.name for f in folders] == [f"shard_{k:05d}" for k in range(len(folders))] and len(folders) >= 7
    arrays = [np.load(f / "images.npy") for f in folders]
    assert all(a.shape[1:] == (2, 3, 1) and len(a) <= 4 for a in arrays)
    assert np.concatenate(arrays)[:, 0, 0, 0].tolist() == list(range(25))
    assert [pq.read_table(f / "meta.parquet").num_rows for f in folders] == [len(a) for a in arrays]
    back = shards.read_shards(spark, str(tmp_path / "out"), META)
    assert sorted((r.code, bytes(r.image), r.label_5d) for r in back.collect()) == [(c, i, x) for _, c, i, x in rows]
    shards.write_shards(df.limit(3), str(tmp_path / "out"), 2, 3, overwrite=False)
    assert shards.read_shards(spark, str(tmp_path / "out"), META).count() == 28
    shards.write_shards(df.limit(0), str(tmp_path / "out"), 2, 3)
    assert not list((tmp_path / "out").iterdir())


def test_failed_writes_leave_nothing(spark, tmp_path):
    df = spark.range(9).select(F.expr("date'2021-01-01'").alias("date"), F.col("id").cast("string").alias("code"), F.when(F.col("id") == 7, F.lit(b"ab")).otherwise(F.lit(b"abcdef")).alias("image"))
    with pytest.raises(Exception, match="2 x 3 bytes"):
        shards.write_shards(df.repartition(3), str(tmp_path / "out"), 2, 3)
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
