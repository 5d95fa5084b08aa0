"""How far the sources of a language part in their words, by joint histograms of counts.

A pair of sources is compared by how often each combination of counts occurs among its terms, those with a zero on one or
both sides included without being formed; the divergence is evaluated once for a combination.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.llm.common import map_batches
from foliomatch.plans.stages import discard, materialize

#: What stands between terms: all of ASCII but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNTED = "lang string, source string, term string, n long, docs long"
SCALE = 1_000_000_000


def _count_slice(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Terms of a slice of documents with their occurrences and documents, by language and source."""
    langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), GAP)
    words = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, rows = words.filter(pa.array(full)).dictionary_encode(), rows[full]
    if not len(words):
        return None
    codes, n_terms = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    in_row, n = np.unique(rows * n_terms + codes, return_counts=True)
    keys, at = np.unique(group[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
    lang, source = np.divmod(keys // n_terms, len(sources.dictionary))
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), words.dictionary.take(pa.array(keys % n_terms)),
            pa.array(np.bincount(at, weights=n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64)),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """``(lang, source, term, n)``: occurrences of the terms that stand in ``least`` documents of their language or more.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, only ``A-Z`` lower-cased. Every row is a document, also a repeated
    one. Counts are summed in slices, in tasks and by key, so no key has more rows than there are tasks.
    """
    counted = map_batches(_plain(docs), _count_slice, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("_d")).where(F.col("_d") >= least).select("lang", "term")
    out = materialize(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")
    discard(counted)
    return out


def _share(count: str, total: str) -> Column:
    """p = 1 + floor(SCALE * (count + 1) / (N + V)); in decimals, as the product outgrows a long."""
    high = (F.col(count) + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.expr("1L") + F.call_function("div", high, (F.col(total) + F.col("v")).cast("decimal(28,0)"))).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per language ``(lang, v, n_lang)`` and per group ``(lang, source, n_group, v)``, those without terms included."""
    by_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    zero = F.lit(0).cast("long")
    groups = _plain(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return langs, materialize(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_group", "v")]), "term-groups")


def joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, ca, cb, m)``: of each pair of sources a < b, the number m > 0 of kept terms with these two counts.

    Terms met in both sources are tallied from their pairs. Those met in one of them, or in none, are what the histogram of
    the one source, or the number of terms, leaves over: each is written as a signed tally, and the tallies of a
    combination add up to its number.
    """
    left, right = (kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(f"c{s}")) for s in "ab")
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    m = F.col("m")
    cell = lambda ca, cb, n: F.struct(ca.cast("long").alias("ca"), cb.cast("long").alias("cb"), n.alias("m"))
    ca, cb = F.col("ca"), F.col("cb")
    met = both.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))))
    single = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    pairs = groups.select("lang", "v", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    none = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m"))
    ones = []
    for own, other, of in (("a", "b", lambda n: (n, zero)), ("b", "a", lambda n: (zero, n))):
        with_other = single.withColumnRenamed("source", own).join(groups.select("lang", F.col("source").alias(other)), "lang")
        ones.append(with_other.where("a < b").select("lang", "a", "b", F.inline(F.array(cell(*of(F.col("n")), m), cell(zero, zero, -m)))))
    every = met.unionByName(none).unionByName(ones[0]).unionByName(ones[1])
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m <> 0")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the divergence of each source from each other one of its language."""
    cells = joint_histograms(kept, groups)
    for s in "ab":
        own = groups.select("lang", F.col("source").alias(s), F.col("n_group").alias(f"n{s}"), *(["v"] if s == "a" else []))
        cells = cells.join(own, ["lang", s])
    cells = cells.withColumns({"p": _share("ca", "na"), "q": _share("cb", "nb")})
    exact = lambda p, q: F.sum(_divergence(F.col(p), F.col(q)).cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)"))
    sums = cells.groupBy("lang", "a", "b").agg(exact("p", "q").alias("ab"), exact("q", "p").alias("ba"))
    sides = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(x + y).cast("long").alias("value")) for x, y in ("ab", "ba")]))
    found = sums.select("lang", sides)
    # where a language keeps no term there is no cell
    bare = groups.where("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return found.unionByName(zeros)


def _terms(kept: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the kept terms that a group has more often than its language."""
    per_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n_term")).join(langs, "lang").withColumn("q", _share("n_term", "n_lang")).select("lang", "term", "q")
    placed = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "n_group"))
    both = placed.join(per_lang, ["lang", "term"]).where("p > q")
    return both.select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, least: int = 3, terms: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank int)``: of each group its other sources and its own terms by divergence.

    With p of the group and q of the other, f = floor((p - q)^2 / q). Part ``pair`` sums f over all kept terms of the
    language, part ``term`` gives f of the terms with p over the q of the language, the first ``terms``. Ranks run by value
    descending, then item ascending. Null text, language and source are empty ones; a group without a term is compared
    like any other; an empty table gives no rows, a single source of a language no pairs; other columns are passed over.
    """
    kept = kept_terms(docs, least)
    langs, groups = _groups(docs, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = _pairs(kept, groups).withColumn("rank", rank)
    own = _terms(kept, langs, groups).withColumn("rank", rank).where(F.col("rank") <= terms)
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", own))]
    return out[0].unionByName(out[1])
