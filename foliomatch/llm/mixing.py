"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.plans.ranges import sums_before
from foliomatch.plans.stages import materialize

#: Weights by rank of the source, repeating; no source is repeated more often than this.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Cells of the sampling key in which sizes are summed before single documents are looked at, and rows of a cell that are sorted.
CELLS, BORDER_ROWS = 1 << 14, 100_000
RESULTS = ("size", "source_size", "target", "epochs", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1] that falls with the share of characters other than letters and spaces: (letters / all)^2."""
    n = F.octet_length(text)
    odd = n - F.octet_length(F.regexp_replace(text, r"[0-9!-/:-@\[-`{-~]+", ""))
    share = F.when(n > 0, 1 - odd / n).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.01), share * share)


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the MD5 of a key: the same in every run and on every engine."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key], F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target double)`` from ``sizes(source, size)``, one row for each source.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share the whole size. A target stops at
    ``MOST_EPOCHS`` times its source's size; what is over goes to the others by weight until none is above. In order
    of size by weight the sources that stop are the first ones, so running sums, taken by ranges, find them all at once.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = sums_before(sizes.select("source", "size"), "mix-sources", [by_name], {"nth": F.lit(1)})
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    w = ranked.withColumn("w", F.element_at(weights, (F.col("nth") % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", F.col("size") * MOST_EPOCHS)
    w = w.withColumn("per", F.col("cap") / F.col("w").cast("double"))
    w = sums_before(w, "mix-caps", [F.col("per").asc(), by_name], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    w = materialize(w, "mix-shares")
    every = w.agg(F.sum("size").alias("every"), F.sum("w").alias("all_w"))  # one row
    rate = (F.col("every") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    w = w.crossJoin(F.broadcast(every)).withColumn("rate", rate)  # what a unit of weight gets if all sources before stop
    w = w.withColumn("stops", F.col("per") <= F.col("rate"))
    final = w.where("NOT stops").agg(F.min(F.struct("per", F.col("source").isNull().alias("last"), "source", "rate"))["rate"].alias("final"))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("final"))
    return w.crossJoin(F.broadcast(final)).select("source", F.col("size").alias("source_size"), target.alias("target"))


def _borders(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``(s, lo, hi, n, ahead)``: of each source with a rest the first cell whose sizes reach it, with the keys it spans.

    ``cells(source, cell, size, n, lo, hi, base)``; ``ahead`` is the size of all rows with lesser keys.
    """
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("upto", F.col("base") + F.sum("size").over(run)).withColumn("ahead", F.col("upto") - F.col("size"))
    met = summed.join(targets.select("s", "rest"), F.col("source").eqNullSafe(F.col("s"))).where("rest > 0 AND ahead < rest AND upto >= rest AND size > 0")
    return met.groupBy("s").agg(F.min(F.struct("cell", "lo", "hi", "n", "ahead")).alias("b")).select("s", "b.lo", "b.hi", "b.n", "b.ahead")


def mix(docs: DataFrame, seed: int = 0, weight: Column | None = None, slim: bool = False) -> DataFrame:
    """Add ``size``, ``source_size``, ``target double``, ``epochs int`` (whole copies to take) and ``taken`` to ``docs``.

    ``docs(doc_id, text, source, ...)``; all other columns stay, but those of these names; with ``slim`` only doc_id and
    source do, and the texts are read once. Every document is taken for each complete epoch of its source's target. What
    is left is drawn by Efraimidis and Spirakis: documents in order of the key -ln(u) / weight, with u from the MD5 of
    doc_id, size and seed, are taken until their sizes reach the rest; the document on the border is taken if that comes
    nearer to it. So reruns agree, and only whole documents are taken. Null texts have size 0, null sources are a source
    of their own, rows equal in key are told apart by doc_id and a hash of the text; rows equal in these too are taken
    or left together. An empty table gives none.

    No task sorts a source: sizes are summed by source and cell of the key, and the cell in which the border lies is cut
    into cells again until it holds ``BORDER_ROWS`` rows at most, which alone are put in order.
    """
    row = F.struct(*(["doc_id", "source"] if slim else [c for c in docs.columns if c not in RESULTS]))
    return _mix(docs, row, seed, weight, slim).select("row.*", *RESULTS)


def _mix(docs: DataFrame, row: Column, seed: int, weight: Column | None, slim: bool) -> DataFrame:
    """``row`` with the results; where it holds nothing but doc_id and source (``slim``) the texts are read once."""
    if weight is None:
        weight = quality_weight(F.col("text"))
    rows = docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), weight.alias("w"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), F.col("size"), seed=seed)) / F.col("w")).drop("w")
    keys = materialize(rows.drop("row"), "mix-keys")
    if slim:
        rows = keys.withColumn("row", F.struct("doc_id", "source"))

    def cells(among: DataFrame, cell: Column, base: Column) -> DataFrame:
        by = among.groupBy("source", F.least(cell, F.lit(CELLS - 1)).cast("int").alias("cell"))
        return by.agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(base).alias("base"))

    zero = F.lit(0).cast("long")
    first = materialize(cells(keys, F.floor(-F.expm1(-F.col("key")) * CELLS), zero), "mix-cells")
    targets = source_targets(first.groupBy("source").agg(F.sum("size").alias("size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - epochs * F.col("source_size"))
    targets = materialize(targets.withColumnRenamed("source", "s"), "mix-targets")

    same = F.col("source").eqNullSafe(F.col("s"))
    border = materialize(_borders(first, targets), "mix-border")
    wide = F.col("n") > BORDER_ROWS
    while not (open_ := border.where(wide & (F.col("hi") > F.col("lo")))).isEmpty():
        among = keys.join(open_.drop("n"), same & F.col("key").between(F.col("lo"), F.col("hi"))).withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi")
        finer = cells(among, F.floor((F.col("key") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.col("ahead"))
        border = materialize(border.where(~(wide & (F.col("hi") > F.col("lo")))).unionByName(_borders(finer, targets)), "mix-border")

    inside = keys.join(border, same & F.col("key").between(F.col("lo"), F.col("hi"))).groupBy("s", "key", "doc_id", "h").agg(F.sum("size").alias("size"), F.min("ahead").alias("ahead"))
    order = Window.partitionBy("s").orderBy("key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("upto", F.col("ahead") + F.sum("size").over(order))
    rest = targets.select(F.col("s").alias("s2"), "rest")
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    last = upto.join(rest, F.col("s").eqNullSafe(F.col("s2"))).where(nearer).groupBy("s").agg(F.max(F.struct("key", "doc_id", "h")).alias("last"))
    # rows up to the last one taken; where none of its cell is, those before the cell
    edge = border.select(F.col("s").alias("s1"), "lo").join(last.withColumnRenamed("s", "s2"), F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2")
    plan = targets.join(edge, F.col("s").eqNullSafe(F.col("s1")), "left").select("s", "source_size", "target", "epochs", "rest", "lo", "last")
    plan = materialize(plan, "mix-plan")  # a row for each source, so its files tell Spark whether to broadcast it

    joined = rows.join(plan, same)
    drawn = F.when(F.col("lo").isNull(), True).when(F.col("key") < F.col("lo"), True).otherwise(F.coalesce(F.struct("key", "doc_id", "h") <= F.col("last"), F.lit(False)))
    taken = F.col("epochs") + F.when((F.col("rest") > 0) & drawn, 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", taken.cast("int").alias("epochs"), (taken * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("epochs")))
    return _mix(docs, F.struct(*docs.columns), seed, None, False).where("epochs > 0").select("row", copies).select("row.*")
