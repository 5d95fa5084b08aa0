"""Runs that can be resumed: stages that were finished for the same input and parameters are read and not run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def input_fingerprint(*tables: DataFrame) -> str:
    """A digest of the files behind ``tables``: their paths, sizes and times. A table that no file stands behind has none."""
    jvm = tables[0].sparkSession.sparkContext._jvm
    conf = tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for df in tables:
        files = df.inputFiles()
        if not files:
            raise ValueError("a table without files cannot be told from another state of itself")
        for file in files:
            path = jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(conf).getFileStatus(path)
            found.append((file, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class Run:
    """A run of named stages under ``root``.

    A stage is a folder whose name comes from all that decides its rows: the fingerprint of the input, the parameters of the
    run, and the names and parameters of the stages before it. Spark marks it finished when all of its files are there; a
    run that is started again reads what is marked and writes what is not anew. Another input or parameter is another
    folder, so nothing stale is ever met.
    """

    def __init__(self, spark: SparkSession, root: str, fingerprint: str, **parameters):
        self.spark, self.root = spark, root.rstrip("/")
        self.key = self._next("", "run", {"input": fingerprint, **parameters})
        #: Names of the stages that this run has worked out, and of those that it found finished.
        self.ran: list[str] = []
        self.found: list[str] = []

    @staticmethod
    def _next(before: str, name: str, parameters: dict) -> str:
        return hashlib.sha256(json.dumps([before, name, parameters], sort_keys=True).encode()).hexdigest()

    def _finished(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def stage(self, name: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The rows of a stage: read, if it was finished before, else those of ``build()``, written and read.

        ``build`` is not called for a finished stage. Stages must come in the same order each time.
        """
        self.key = self._next(self.key, name, parameters)
        path = f"{self.root}/{name}-{self.key[:32]}"
        if self._finished(path):
            self.found.append(name)
        else:
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.ran.append(name)
        return self.spark.read.parquet(path)
