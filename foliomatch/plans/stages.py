"""Cutting a long plan into written stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A local session that names none, as in tests, uses a temporary folder of this process. On a cluster executors could not
    read that, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="foliomatch-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the driver ends."""
    path = f"{shared_dir(spark)}/foliomatch/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: With it Spark deletes the shuffle files of a query when it ends, and not when the driver next collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The lineage ends at replicated files, so a lost executor costs a read and not a recomputation. ``release`` deletes the
    shuffle files of the write as soon as it has ended.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(RELEASE, None)
    if release:
        conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stage of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` over all cores, if its scan has fewer partitions than the session has cores; else as it is.

    A table in one small file would keep all work on its rows in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores, *keys)
