"""Members of an ensemble, one for each loss, experiment, fold and seed, trained once whatever happens in between.

A member's model and predictions are written to folders of their own; its manifest, a JSON file that says what they are, comes last
and by a rename, so a manifest never stands beside something unfinished. A run skips members whose manifest, model and
predictions are there, and redoes the others from an empty folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Member:
    loss: str
    experiment: str
    fold: int
    seed: int

    def folder(self, root: str, kind: str) -> str:
        return f"{root}/{kind}/loss={self.loss}/experiment={self.experiment}/fold={self.fold}/seed={self.seed}"


class Store:
    """The members under ``root``, in any file system of Spark's."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def _read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self.path(path), False)
        if not self.fs.rename(self.path(part), self.path(path)):
            raise OSError(f"can't rename to {path}")

    def manifest(self, member: Member) -> dict | None:
        """What a finished member's manifest says; None if any of its parts is missing or another member's."""
        done = f"{member.folder(self.root, 'done')}/manifest.json"
        parts = [f"{member.folder(self.root, 'predictions')}/_SUCCESS", f"{member.folder(self.root, 'models')}/metadata/_SUCCESS"]
        if not all(map(self._exists, [done, *parts])):
            return None
        try:
            found = json.loads(self._read(done))
        except ValueError:
            return None
        except Py4JJavaError as e:
            if "ChecksumException" in e.java_exception.getClass().getName():  # cut off, so not finished
                return None
            raise
        return found if {k: found.get(k) for k in asdict(member)} == asdict(member) else None

    def trained(self, member: Member, make: Callable[[], tuple[MLWritable, DataFrame, dict]]) -> dict:
        """The member's manifest; ``make`` (the model, its predictions, facts for the manifest) is called only if the member isn't finished."""
        if known := self.manifest(member):
            return known
        for kind in ("done", "predictions", "models"):
            self.fs.delete(self.path(member.folder(self.root, kind)), True)
        model, pred, facts = make()
        model.write().save(member.folder(self.root, "models"))
        pred.write.parquet(member.folder(self.root, "predictions"))
        row = asdict(member) | facts | {"model_path": member.folder(self.root, "models"), "prediction_path": member.folder(self.root, "predictions")}
        self._write(f"{member.folder(self.root, 'done')}/manifest.json", json.dumps(row, sort_keys=True, default=str))
        return row

    def predictions(self) -> DataFrame:
        """Predictions of all members, with loss, experiment, fold and seed."""
        df = self.spark.read.option("basePath", f"{self.root}/predictions").parquet(f"{self.root}/predictions")
        return df.withColumns({"fold": F.col("fold").cast("int"), "seed": F.col("seed").cast("int")})
