"""Classification of candidate pairs by comparing their sequences of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.functions.fingerprints import MAX_HASH_DISTANCE, bands, hamming, hash_to_long
from foliomatch.operators.candidates import SERIES_REASON
from foliomatch.plans.stages import materialize

# Fixed values of the comparison at fixed offsets.
OFFSETS = (-2, -1, 0, 1, 2)
LEAST_SHARE, LEAST_MATCHES, AREA_RATIO = 0.90, 3, 1.15
# Fixed values of the comparison at any offset.
CONTAINED_SHARE, CONTAINED_UNITS, PARTIAL_SHARE, PARTIAL_UNITS, MAX_BUCKET_UNITS = 0.90, 3, 0.30, 5, 200
# Fixed values of the comparison of dated series without order.
SERIES_SHARE, SERIES_UNITS = 0.8, 3


def _ends(pairs: DataFrame, units: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The units of both ends of every pair."""
    left = pairs.select("a", "b").join(units.select(F.col("archive_id").alias("a"), F.col("pos").alias("lp"), *[F.col(c).alias(f"l_{c}") for c in columns]), "a")
    right = pairs.select("a", "b").join(units.select(F.col("archive_id").alias("b"), F.col("pos").alias("rp"), *[F.col(c).alias(f"r_{c}") for c in columns]), "b")
    return left, right


def units_match() -> Column:
    """Equal whole hashes, or short hashes that differ in few bits."""
    near = hamming(hash_to_long(F.col("l_dhash")), hash_to_long(F.col("r_dhash"))) <= MAX_HASH_DISTANCE
    return (F.col("l_pixel") == F.col("r_pixel")) | F.coalesce(near, F.lit(False))


def sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("archive_id").agg(F.count("*").cast("int").alias("n"))


def with_sizes(pairs: DataFrame, units: DataFrame) -> DataFrame:
    n = sizes(units)
    out = pairs.join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left")
    return out.withColumns({"na": F.coalesce("na", F.lit(0)), "nb": F.coalesce("nb", F.lit(0))})


def fixed_offset_matches(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``(a, b, shift, lp, rp, l_area, r_area, same)``: units that match at a shift of two at most, position by position;
    ``same`` if their whole hashes are equal.

    Units of the right side are gathered by the position that they are held against, five of them at most, before any
    pair is formed; so a pair is a row for each unit of its left side and not for each shift and each unit of both.
    """
    own = units.select("archive_id", "pos", "pixel", hash_to_long(F.col("dhash")).alias("h"), "area")
    left = pairs.select("a", "b").join(own.toDF("a", "lp", "l_pixel", "l_h", "l_area"), "a")
    moved = own.withColumn("shift", F.explode(F.array(*[F.lit(o) for o in OFFSETS]))).withColumn("lp", F.col("pos") - F.col("shift"))
    unit = F.struct("shift", F.col("pos").alias("rp"), F.col("area").alias("r_area"), "pixel", "h")
    near = moved.groupBy(F.col("archive_id").alias("b"), "lp").agg(F.collect_list(unit).alias("near"))
    match = lambda x: (F.col("l_pixel") == x["pixel"]) | F.coalesce(hamming(F.col("l_h"), x["h"]) <= MAX_HASH_DISTANCE, F.lit(False))
    found = left.join(near, ["b", "lp"]).select("a", "b", "lp", "l_area", "l_pixel", F.inline(F.filter("near", match)))
    return found.select("a", "b", "shift", "lp", "rp", "l_area", "r_area", F.coalesce(F.col("l_pixel") == F.col("pixel"), F.lit(False)).alias("same"))


def best_fixed_offset(matches: DataFrame) -> DataFrame:
    """``(a, b, shift, matched, l_median, r_median, equal)``: most matches, then the smaller shift, then the negative one;
    ``equal`` counts the units that are the same at their place, null where none match there."""
    by = matches.groupBy("a", "b", "shift").agg(F.count("*").cast("int").alias("matched"), F.median("l_area").alias("l_median"), F.median("r_area").alias("r_median"), F.count_if("same").alias("same"))
    order = F.struct("matched", -F.abs("shift"), -F.col("shift"))
    best = by.groupBy("a", "b").agg(F.max_by(F.struct("shift", "matched", "l_median", "r_median"), order).alias("m"), F.max(F.when(F.col("shift") == 0, F.col("same"))).alias("equal"))
    return best.select("a", "b", "m.*", "equal")


def resolution_verdict(left: Column, right: Column) -> Column:
    """Which side's median area is larger by ``AREA_RATIO`` at least."""
    return F.when(left >= right * AREA_RATIO, "KEEP_LEFT_HIGHER_RESOLUTION").when(right >= left * AREA_RATIO, "KEEP_RIGHT_HIGHER_RESOLUTION").otherwise("MANUAL")


def resolution_reason(left: Column, right: Column) -> Column:
    return (
        F.when(left.isNull() | right.isNull(), "NO_MATCHED_PAGE_RESOLUTION_EVIDENCE")
        .when(left >= right * AREA_RATIO, "LEFT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER")
        .when(right >= left * AREA_RATIO, "RIGHT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER")
        .otherwise("MEDIAN_PIXEL_AREA_DIFFERENCE_BELOW_15_PERCENT")
    )


def bag_overlap(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``(a, b, common)``: units that both ends hold, counted as often as both do, whatever their order."""
    counts = units.where("pixel <> ''").groupBy("archive_id", "pixel").agg(F.count("*").alias("n"))
    left = pairs.select("a", "b").join(counts.toDF("a", "pixel", "nl"), "a")
    both = left.join(counts.toDF("b", "pixel", "nr"), ["b", "pixel"])
    return both.groupBy("a", "b").agg(F.sum(F.least("nl", "nr")).cast("int").alias("common"))


def classify_pairs(seeds: DataFrame, containers: DataFrame, units: DataFrame) -> DataFrame:
    """``relations(a, b, relation, confidence, matched, na, nb, reasons, recommendation)`` of ``seeds(a, b, reasons)``.

    The first rule that holds decides: an unstable end; equal whole hashes; equal units in order; at least 0.9 of the
    larger side's units match at one shift and sizes are close; for a dated series most of the smaller side's units are
    held by the other; else the pair is merely related. ``containers`` may have ``stable boolean`` and ``error string``.
    """
    stable = F.coalesce("stable", F.lit(True)) if "stable" in containers.columns else F.lit(True)
    error = F.col("error") if "error" in containers.columns else F.lit(None).cast("string")
    ends = containers.select("archive_id", "file_sha256", stable.alias("stable"), error.alias("error"))
    pairs = seeds.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reasons").where("a <> b")
    known = materialize(with_sizes(pairs, units).join(ends.toDF("a", "sa", "oka", "ea"), "a").join(ends.toDF("b", "sb", "okb", "eb"), "b"), "known-ends")
    unstable = ~F.col("oka") | ~F.col("okb")
    copies = (F.col("sa") != "") & (F.col("sa") == F.col("sb"))
    # the units of copies and of unstable ends decide nothing
    compared = known.where(~F.coalesce(unstable | copies, F.lit(False))).select("a", "b").distinct()
    facts = (
        known.join(best_fixed_offset(fixed_offset_matches(compared, units)), ["a", "b"], "left")
        .join(bag_overlap(pairs.where(F.array_contains("reasons", SERIES_REASON)), units), ["a", "b"], "left")
    )
    largest, smallest = F.greatest("na", "nb"), F.least("na", "nb")
    matched = F.coalesce("matched", F.lit(0))
    share = F.coalesce(F.try_divide(matched, largest), F.lit(0.0))
    common = F.coalesce("common", F.lit(0))
    covered = F.coalesce(F.try_divide(common, smallest), F.lit(0.0))
    in_order = (F.col("na") == F.col("nb")) & (F.col("na") > 0) & (F.coalesce("equal", F.lit(0)) == F.col("na"))
    close = F.abs(F.col("na") - F.col("nb")) <= F.greatest(F.lit(2), F.ceil(largest * 0.05))
    variant = (share >= LEAST_SHARE) & close & (matched >= LEAST_MATCHES)
    series = (common >= SERIES_UNITS) & (covered >= SERIES_SHARE)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    reason = resolution_reason(F.col("l_median"), F.col("r_median"))
    aligned = F.array(text("FIXED_OFFSET_", F.coalesce("shift", F.lit(0)).cast("string")), text("MATCHED_PAGES_", matched.cast("string"), "_OF_", largest.cast("string")))
    why = (
        F.when(unstable, F.array_compact(F.array(F.lit("UNSTABLE_SOURCE_SNAPSHOT"), F.when(~F.col("oka"), F.col("ea")), F.when(~F.col("okb"), F.col("eb")))))
        .when(copies, F.array(F.lit("IDENTICAL_ARCHIVE_SHA256")))
        .when(in_order, F.array(F.lit("ALL_PIXEL_SHA256_IN_ORDER"), reason))
        .when(variant, F.concat(aligned, F.array(reason)))
        .when(series, F.array(text("DATED_SERIES_COMMON_", common.cast("string"), "_OF_", smallest.cast("string")), text("DATED_SERIES_ADDED_", F.abs(F.col("na") - F.col("nb")).cast("string"))))
        .otherwise(aligned)
    )
    return facts.select(
        "a",
        "b",
        F.when(unstable, "RELATED").when(copies, "EXACT_ARCHIVE").when(in_order, "EXACT_CONTENT").when(variant, "VISUAL_VARIANT").otherwise("RELATED").alias("relation"),
        F.when(unstable, 0.0).when(copies | in_order, 1.0).when(variant, share).when(series, covered).otherwise(share).alias("confidence"),
        F.when(unstable, 0).when(copies, smallest).when(in_order, F.col("na")).when(variant, matched).when(series, common).otherwise(matched).cast("int").alias("matched"),
        "na",
        "nb",
        F.concat("reasons", why).alias("reasons"),
        F.when(unstable, "MANUAL").when(copies, "MANUAL_EQUIVALENT_PATHS").when(in_order | variant, resolution_verdict(F.col("l_median"), F.col("r_median"))).otherwise("MANUAL").alias("recommendation"),
    )


def usable_edge() -> Column:
    """Edges that may join containers into a group."""
    return (F.col("relation") != "RELATED") | ((F.col("matched") >= 2) & (F.col("confidence") >= 0.5))


def aligned_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``(a, b, offset, lp, rp)``: units that match anywhere, found through equal whole hashes or equal bands.

    A key that more than ``MAX_BUCKET_UNITS`` units of the right side share finds none.
    """
    left, right = _ends(pairs, units, "pixel", "dhash")

    def keyed(df: DataFrame, side: str) -> DataFrame:
        short = F.transform(bands(hash_to_long(F.col(f"{side}_dhash"))), lambda k: F.concat_ws(":", k["band"].cast("string"), k["key"].cast("string")))
        keys = F.concat(F.array(F.col(f"{side}_pixel")), F.coalesce(short, F.array().cast("array<string>")))
        return df.withColumn("key", F.explode(F.array_distinct(keys)))

    right = keyed(right, "r")
    fit = right.groupBy("a", "b", "key").agg(F.count("*").alias("_n")).where(F.col("_n") <= MAX_BUCKET_UNITS).drop("_n")
    found = keyed(left, "l").join(right.join(fit, ["a", "b", "key"], "left_semi"), ["a", "b", "key"]).where(units_match())
    return found.select("a", "b", (F.col("rp") - F.col("lp")).alias("offset"), "lp", "rp").distinct()


def best_alignment(aligned: DataFrame) -> DataFrame:
    """``(a, b, offset, matched, pairs)``: most matches, then densest, then the smaller offset, then the negative one."""
    density = F.count("*") / (F.max("lp") - F.min("lp") + 1)
    by = aligned.groupBy("a", "b", "offset").agg(F.count("*").cast("int").alias("matched"), density.alias("density"), F.array_sort(F.collect_list(F.struct("lp", "rp"))).alias("pairs"))
    order = F.struct("matched", "density", -F.abs("offset"), -F.col("offset"))
    return by.groupBy("a", "b").agg(F.max_by(F.struct("offset", "matched", "pairs"), order).alias("m")).select("a", "b", "m.*")


def sequence_relations(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``(a, b, relation, container, matched, na, nb, left_share, right_share, pairs)``: what contains or overlaps what.

    Pairs that agree nearly whole at similar sizes are no finding here, as the comparison at fixed offsets has them.
    """
    rows = with_sizes(best_alignment(aligned_units(pairs, units)), units)
    left, right = F.col("matched") / F.col("na"), F.col("matched") / F.col("nb")
    large, small, best = F.greatest("na", "nb"), F.least("na", "nb"), F.greatest(left, right)
    alike = (left >= CONTAINED_SHARE) & (right >= CONTAINED_SHARE) & (large - small <= F.greatest(F.lit(2), F.ceil(large * 0.05)))
    contains = (F.col("matched") >= CONTAINED_UNITS) & (best >= CONTAINED_SHARE) & (large >= small + 2)
    partial = (F.col("matched") >= PARTIAL_UNITS) & (best >= PARTIAL_SHARE)
    relation = F.when(alike, None).when(contains, "CONTAINS").when(partial, "PARTIAL_OVERLAP")
    container = F.when(contains, F.when(F.col("na") > F.col("nb"), F.col("a")).otherwise(F.col("b")))
    out = rows.select("a", "b", relation.alias("relation"), container.alias("container"), "matched", "na", "nb", left.alias("left_share"), right.alias("right_share"), "pairs")
    return out.where("relation IS NOT NULL")


def unmatched_units(sequences: DataFrame) -> DataFrame:
    """``(a, b, left_rest, right_rest)``: positions of either side that the alignment leaves over."""
    def rest(n: str, side: str) -> Column:
        return F.array_except(F.sequence(F.lit(0), F.col(n) - 1), F.transform("pairs", lambda p: p[side]))

    return sequences.select("a", "b", rest("na", "lp").alias("left_rest"), rest("nb", "rp").alias("right_rest"))
