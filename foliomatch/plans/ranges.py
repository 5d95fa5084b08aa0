"""Rows dealt by ranges of a total order, so that running sums and neighbours need no task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.plans.stages import materialize, shuffle_partitions


def in_ranges(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``_range int``, written: rows of a lower range come before those of a higher one under ``order``."""
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), name)


def sums_before(df: DataFrame, name: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a long for each of ``sums``: its total over all rows that come before under ``order``.

    Every range sums its own rows; the running sums over the ranges, as many as the session has shuffle partitions, give
    each its start, and a window inside the range does the rest.
    """
    dealt = in_ranges(df, name, *order)
    zero = F.lit(0).cast("long")
    totals = materialize(dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(sums.values())]), f"{name}-totals")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(ahead), zero).alias(f"_s{i}") for i in range(len(sums))])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"_u{i}": F.coalesce(F.sum(v).over(upto), zero) for i, v in enumerate(sums.values())})
    placed = placed.join(F.broadcast(starts), "_range")
    return placed.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_u{i}")).cast("long").alias(n) for i, n in enumerate(sums)])
