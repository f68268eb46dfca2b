"""Model persistence: save, load, load-or-train (A13).

``load_or_train`` keeps one model at a path the caller names.  ``ModelStore``
keeps many below one folder, keyed by a digest of the training rows and the
parameters, so that a model is reused exactly when it would come out the same.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M = TypeVar("M")


def save_model(model, path: str) -> str:
    """Store a model; an existing one is never replaced (that is an error)."""
    model.write().save(path)
    return path


def stored(path: str) -> bool:
    """Whether anything lies at ``path``, asked of its own file system."""
    spark = SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_or_train(path: str, loader: Callable[[str], M], train: Callable[[], M]) -> M:
    """Load the model stored at ``path``; train and store it only if nothing is
    there.  A model that cannot be read is an error and stays as it is."""
    if stored(path):
        return loader(path)
    model = train()
    save_model(model, path)
    return model


def data_digest(data: DataFrame, **parameters) -> str:
    """A key of the rows (their number and the sums of two row hashes: no
    order, no partitioning), the schema and the parameters."""
    cols = sorted(data.columns)
    hashes = [F.sum(h(*cols).cast("decimal(38,0)")) for h in (F.xxhash64, F.hash)]
    row = data.agg(F.count(F.lit(1)), *hashes).first()
    said = json.dumps([[str(x) for x in row], sorted(data.dtypes), parameters], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


class ModelStore:
    """Models below ``base`` by key.

    A model is first written to an attempt folder of its own and then published
    by creating the marker ``<key>/published``, which names the attempt.  The
    marker is created once or not at all: a run that dies while writing leaves
    an attempt nobody reads, and of two writers the first one's model stands.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _marker(self, key: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{key}/published")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def published(self, key: str) -> str | None:
        """The folder of the published model of ``key``, if there is one."""
        files, place = self._marker(key)
        if not files.exists(place):
            return None
        return f"{self.base}/{key}/{self.spark.read.text(place.toString()).first()[0]}"

    def publish(self, key: str, model) -> str:
        """Write ``model`` and publish it, unless another one was first."""
        attempt = f"attempt-{uuid.uuid4().hex}"
        save_model(model, f"{self.base}/{key}/{attempt}")
        files, place = self._marker(key)
        try:
            out = files.create(place, False)
        except Exception:  # noqa: BLE001 - the marker is there: the other model stands
            if not files.exists(place):
                raise
        else:
            out.write(bytearray(attempt.encode()))
            out.close()
        return self.published(key)

    def load_or_train(self, key: str, loader: Callable[[str], M], train: Callable[[], M]) -> tuple[M, bool]:
        """(model, whether it was in the store); a trained one is published
        and read back, so every caller works with the stored model."""
        folder = self.published(key)
        if folder:
            return loader(folder), True
        return loader(self.publish(key, train())), False
