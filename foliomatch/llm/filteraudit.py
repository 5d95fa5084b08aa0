"""How quality filters overlap: what each removes at every place of every order, counted from one pass of words.

A relational pipeline. Words are exploded and counted by ``(document, word)`` and then by document, which gives totals and
distinct words; the other flags are joined to these, each document becomes one of 32 sets of failed filters, and one
aggregation of conditional counts by part holds all that the orders need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Stands for a missing id in keys; whether an id is missing is kept beside it.
NO_ID = -(1 << 63)
#: Rows of one id and one text are dealt over so many keys.
SALTS = 64


def _keyed(docs: DataFrame) -> DataFrame:
    """``(_id, _digest, _text, ...)``: a text is known by its SHA-256, a missing id by ``NO_ID``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.col("doc_id").isNull().alias("_bare"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        text.alias("_text"),
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """``(_id, _digest, total, different)``: words and different words of each id and text that has a word.

    Texts are dealt out once by id, digest and a salt, so both counts by ``(document, word)`` and by document stay where
    the words are. Rows equal in all three are counted together and divided by their number, that of their first words.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    dealt = _keyed(docs).select("_id", "_digest", salt.alias("_salt"), "_text").repartition("_id", "_digest", "_salt")
    key = ["_id", "_digest", "_salt"]
    parts = F.filter(F.split("_text", WORD_GAP), lambda w: w != "")
    words = dealt.select(*key, F.posexplode(parts).alias("_at", "_word"))
    by_word = words.groupBy(*key, "_word").agg(F.count("*").alias("n"), F.sum((F.col("_at") == 0).cast("long")).alias("firsts"))
    by_row = by_word.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("different"), F.sum("firsts").alias("rows"))
    each = by_row.select("_id", "_digest", F.expr("n div rows").alias("total"), "different")
    return each.groupBy("_id", "_digest").agg(F.max("total").alias("total"), F.max("different").alias("different"))


def failed_filters(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, failed int, n long)``: the filters that documents fail, bit 0 for A; equal rows are counted in ``n``.

    A: under 50 words; B: under 65 different words in 100; C: over 5 capitals ``A-Z`` in 100 code points; D: holds one of
    ``#$%&*|``; E: the text of a smaller doc_id. A null text is empty, a null source the empty one. A row without an id is
    no copy and is the smaller one of nobody; rows of one doc_id are no copies of each other.
    """
    keyed = _keyed(docs)
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    flags = F.when(100 * capitals.cast("long") > 5 * F.length("_text").cast("long"), 4).otherwise(0) + F.when(F.col("_text").rlike("[#$%&*|]"), 8).otherwise(0)
    rows = keyed.select("_id", "_bare", "_digest", "part", flags.alias("_flags")).groupBy("_id", "_bare", "_digest", "part", "_flags").agg(F.count("*").alias("n"))
    # the least id of a text: matched by id and text together, so no key has more rows than one document
    firsts = keyed.where(~F.col("_bare")).groupBy("_digest").agg(F.min("_id").alias("_id")).select("_id", "_digest", F.lit(True).alias("_first"))
    joined = rows.join(firsts, ["_id", "_digest"], "left").join(word_counts(docs), ["_id", "_digest"], "left")
    total, different = (F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "different"))
    few, same = F.when(total < 50, 1).otherwise(0), F.when(100 * different < 65 * total, 2).otherwise(0)
    copy = F.when(F.col("_first").isNull() & ~F.col("_bare"), 16).otherwise(0)
    doc_id = F.when(~F.col("_bare"), F.col("_id"))
    return joined.select(doc_id.alias("doc_id"), "_digest", "part", (F.col("_flags") + few + same + copy).cast("int").alias("failed"), "n")


def count_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, n, good, toxic)``: per part three arrays of 32 longs, the documents by the set of filters that they fail.

    ``good`` and ``toxic`` count those with quality or toxic 1 in any row of ``labels``.
    """
    failed = failed_filters(docs)
    # rows without an id are dealt by their text and match nothing
    failed = failed.withColumns({"_key": F.coalesce("doc_id", F.xxhash64("_digest")), "_has": F.col("doc_id").isNotNull()})
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")])
    marked = failed.join(marks.withColumn("_has", F.lit(True)), ["_key", "_has"], "left")
    weights = {"n": F.col("n"), "good": F.col("n") * F.coalesce("_quality", F.lit(0)), "toxic": F.col("n") * F.coalesce("_toxic", F.lit(0))}
    slim = marked.select("part", "failed", *[w.alias(c) for c, w in weights.items()])
    sets = range(1 << len(FILTERS))
    sums = [F.sum(F.when(F.col("failed") == s, F.col(c)).otherwise(0)).alias(f"{c}_{s}") for c in weights for s in sets]
    wide = slim.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[f"{c}_{s}" for s in sets]).alias(c) for c in weights])


def _total(counts: str, wanted) -> Column:
    """Sum of an array of 32 counts over the sets for which ``wanted`` holds."""
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), zero, lambda a, s: a + F.when(wanted(s), F.get(counts, s)).otherwise(zero))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``.

    All counts come from those of ``count_failures``. ``shapley`` sums what the step's filter removes over all orders: of
    a document that fails k filters each removes it in 120 / k. Other columns of ``docs`` are passed over; an empty table
    has no parts and gives no rows.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = count_failures(docs, labels).select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = [F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", i, 1)) - ord("A")) for i in range(1, len(FILTERS) + 1)]
    before = sum((F.when(F.col("step") > i, b).otherwise(0) for i, b in enumerate(bits, 1)), F.lit(0))
    placed = steps.withColumns({"_bit": F.element_at(F.array(*bits), F.col("step")), "_before": before})
    bit, seen = F.col("_bit"), F.col("_before")

    def has(s, mask):
        return s.bitwiseAND(mask) != 0

    removed = lambda s: has(s, bit) & ~has(s, seen)
    shares = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)), F.lit(0).cast("long"), lambda a, s: a + F.when(has(s, bit), F.get("n", s) * (F.lit(120) / F.bit_count(s)).cast("long")).otherwise(0)
    )
    return placed.select(
        "part", "filter_order", "step",
        _total("n", lambda s: ~has(s, bit) & ~has(s, seen)).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", lambda s: has(s, bit) & has(s, seen)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        shares.alias("shapley"),
    )
