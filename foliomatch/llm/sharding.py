"""Contiguous shards of equal bytes from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.plans.ranges import sums_before
from foliomatch.plans.stages import materialize

RESULTS = ("size", "text_crc32", "shard", "slot")


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", slim: bool = False) -> DataFrame:
    """Add ``size long`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard int`` and ``slot long`` to ``docs``.

    Rows in order of ``key`` are cut into ``n_shards`` runs of nearly equal bytes: a row belongs to the shard in whose
    equal share the middle of its bytes lies, so a shard differs from its share by half a row at either end. ``slot``
    numbers a shard's rows from 0 without gaps. A null text has size 1; a null key comes first; rows equal in key are
    ordered by text checksum and size, equal ones at will. Other columns stay, but those of these names; with ``slim`` only
    ``key`` does and no text is moved. A text larger than a share may leave shards empty; an empty table gives no rows.

    Spark deals rows into ranges of that order; every range sums its bytes and rows, and the running sums over the ranges
    give each its start.
    """
    kept = [key] if slim else [c for c in docs.columns if c not in RESULTS]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*kept).alias("row"), size.alias("size"), crc.alias("text_crc32"))
    order = [F.col(f"row.{key}").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    placed = sums_before(rows, "shard-ranges", order, {"bytes_before": F.col("size"), "rows_before": F.lit(1)})
    every = rows.agg(F.sum("size").alias("every"))  # one row
    middle = 2 * F.col("bytes_before") + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * F.col("every")))).cast("int")
    placed = placed.crossJoin(F.broadcast(every)).withColumn("shard", shard)
    placed = materialize(placed.select("row", "size", "text_crc32", "rows_before", "shard"), "shards")
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")  # n_shards rows
    return out.select("row.*", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write the rows of ``docs`` as one folder per shard, in order of slot within each file."""
    placed = shard_by_bytes(docs, n_shards)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
