"""The parts of the engine that work on what is new: rescans, the latest action, and windows over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliomatch.operators.review import latest


def rescan(known: DataFrame, seen: DataFrame, complete: bool = True) -> DataFrame:
    """``(path, outcome)``: REUSED, CHANGED or NEW for what was seen now, MISSING for what was not.

    Both are ``(path, file_size, mtime_ns)``. An interrupted discovery (``complete`` false) calls nothing missing.
    """
    k = known.select("path", F.struct("file_size", "mtime_ns").alias("k"))
    s = seen.select("path", F.struct("file_size", "mtime_ns").alias("s"))
    both = k.join(s, "path", "full" if complete else "right")
    outcome = F.when(F.col("s").isNull(), "MISSING").when(F.col("k").isNull(), "NEW").when(F.col("k") == F.col("s"), "REUSED").otherwise("CHANGED")
    return both.select("path", outcome.alias("outcome"))


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs of an interrupted run that have no result yet."""
    return jobs.join(done.select("path").distinct(), "path", "left_anti")


def stream_ledger(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A file stream of ledger rows; a batch takes so many files at most, which bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_latest(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """The rows that ``keep_latest`` has at ``target``, with ``bucket`` and ``v``: of each bucket its newest version, or the newest
    one before batch ``before``."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*fields.fields, *StructType.fromDDL("bucket int, v long").fields])).parquet(target)
    rows = rows if before is None else rows.where(F.col("v") < before)
    # a row for each bucket, a number that the caller sets
    newest = rows.select("bucket", "v").groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(newest), ["bucket", "v"], "left_semi")


def keep_latest(stream: DataFrame, target: str, checkpoint: str, key: str = "archive_id", order: str = "id", buckets: int = 64) -> StreamingQuery:
    """Maintain the latest row of each key at ``target``, in buckets by hash of the key.

    A batch reads and writes the buckets that it touches alone. ``target/bucket=B/v=N`` is written under the batch's number,
    so a batch that is run again replaces its own result and reads what was there before it; versions older than the one
    that a batch has read are deleted. ``read_latest`` gives the state.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        store = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old: dict[int, int] = {}
        if store.exists(files):
            touched = rows.select("bucket").distinct()  # at most ``buckets`` rows
            before = read_latest(spark, target, batch.schema, number).join(F.broadcast(touched), "bucket", "left_semi")
            old = {r.bucket: r.v for r in before.select("bucket", "v").distinct().collect()}
            rows = rows.unionByName(before.drop("v"))
        out = latest(rows, key, order).withColumn("v", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(target)
        for bucket, read in old.items():
            for one in store.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={bucket}")):
                if int(one.getPath().getName()[2:]) < read:
                    store.delete(one.getPath(), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def action_windows(stream: DataFrame, late: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``(start, action, n)``: actions by window, with a watermark for late rows; an addition of this engine.

    ``late`` is None for a stream that has a watermark already.
    """
    rows = (stream.withWatermark("ts", late) if late else stream).groupBy(F.window("ts", width), "action").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "action", "n")


def distinct_actions(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ledger rows without repeated ids inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
