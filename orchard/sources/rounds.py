"""Committed rounds: the labelled rows and the log of a loop, one folder a round.

A step (``start`` or a round) is first staged in an attempt folder of its own:
its rows as Parquet, its log line as JSON.  It counts from the moment its
marker, an empty file beside the attempt, is created; a run that dies earlier
leaves an attempt nobody reads, and a later run takes that round again.  The
folder may lie on any file system the session can write.  One run at a time
writes a folder; any number may read it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DONE = ".done"


class RoundLog:
    """Steps below ``base`` by name; names in ascending order are the order of steps."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def committed(self) -> dict[str, str]:
        """The attempt folder of every committed step, in order of the steps."""
        files, pattern = self._place(f"{self.base}/*/*{_DONE}")
        steps: dict[str, str] = {}
        for marker in sorted(s.getPath().toString() for s in files.globStatus(pattern) or ()):
            steps.setdefault(marker.split("/")[-2], marker.removesuffix(_DONE))
        return steps

    def stage(self, step: str, rows: DataFrame) -> str:
        """Write the rows of a step to a new attempt folder and return it."""
        attempt = f"{self.base}/{step}/attempt-{uuid.uuid4().hex}"
        rows.write.parquet(f"{attempt}/rows")
        return attempt

    def commit(self, attempt: str, line: Mapping | None = None) -> str:
        """Add the step's log line, then make the attempt count."""
        if line is not None:
            files, place = self._place(f"{attempt}/log.json")
            out = files.create(place, False)
            out.write(bytearray((json.dumps(dict(line)) + "\n").encode()))
            out.close()
        files, marker = self._place(attempt + _DONE)
        if not files.createNewFile(marker):
            raise FileExistsError(f"{attempt} is committed already")
        return attempt

    def rows(self, schema: T.StructType | None = None) -> DataFrame:
        """The rows of all committed steps."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{a}/rows" for a in self.committed().values()])

    def lines(self, schema: T.StructType) -> DataFrame:
        """The log lines of the committed steps that have one."""
        logs = [f"{a}/log.json" for a in self.committed().values()]
        logs = [p for p in logs if self._exists(p)]
        if not logs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(logs)

    def _exists(self, path: str) -> bool:
        files, place = self._place(path)
        return files.exists(place)
