"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.plans.stages import discard, materialize


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(a.alias("a"), b.alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _pairs(both.join(least, "a").where("b > a"), F.col("b"), F.col("m"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _pairs(moved.unionByName(least.withColumnRenamed("m", "b")), F.col("a"), F.col("b"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of the undirected graph with ``edges(a, b)``: ``(node, component)``, component = least node.

    Every node of an edge gets a row; loops and repeated edges are harmless, null ends are ignored, no edges give no
    rows. A round is two aggregations with map-side combining and two joins that adaptive execution may split, so a
    hub needs no special care; the number of rounds grows with the logarithm of the longest path. ``max_rounds`` is a
    guard that raises, never a silent stop.
    """
    edges = _pairs(edges.where("a IS NOT NULL AND b IS NOT NULL"), F.col("a"), F.col("b"))
    edges = materialize(edges, "edges")
    before = None
    for _ in range(max_rounds):
        last, edges = edges, materialize(_small_star(_large_star(edges)), "stars")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("archive_id")).distinct()


def regrouped(groups: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``(archive_id, component)`` of the edges ``after(a, b)``, from the ``groups`` of ``before(a, b)``.

    A group without a changed edge stays as it is. One that only gains edges stands in as its label, so its own edges are
    not looked at again; one that loses an edge is dissolved, and its members and edges go through the rounds with those
    that were added. A group from which all edges are gone is no group any more. Direction, repetition and loops of edges
    do not matter, null ends are ignored; without groups everything is new, without edges nothing is left.
    """
    old, new = (_pairs(e.where("a IS NOT NULL AND b IS NOT NULL"), F.least("a", "b"), F.greatest("a", "b")) for e in (before, after))
    added = materialize(new.join(old, ["a", "b"], "left_anti"), "added-edges")
    removed = materialize(old.join(new, ["a", "b"], "left_anti"), "removed-edges")
    changed = _ends(added).withColumn("cut", F.lit(False)).unionByName(_ends(removed).withColumn("cut", F.lit(True)))
    touched = groups.join(changed, "archive_id").groupBy("component").agg(F.bool_or("cut").alias("cut"))
    touched = materialize(touched, "touched-groups")
    # what stands for a member in the rounds: itself in a dissolved group, else the label of its group
    seats = groups.join(touched, "component").select("archive_id", "component", "cut", F.when(F.col("cut"), F.col("archive_id")).otherwise(F.col("component")).alias("seat"))
    seats = materialize(seats, "seats")
    inside = new.join(seats.where("cut").select(F.col("archive_id").alias("a")), "a", "left_semi")
    again = added.unionByName(inside).distinct()
    for end in "ab":
        seat = seats.select(F.col("archive_id").alias(end), F.col("seat").alias(f"_{end}"))
        again = again.join(seat, end, "left")
    roots = connected_components(again.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    placed = seats.join(roots.toDF("seat", "_root"), "seat", "left")
    # a seat without a root has no edge: a member of a dissolved group is alone now, another group is as it was
    moved = placed.select("archive_id", F.when(F.col("cut"), F.col("_root")).otherwise(F.coalesce("_root", "component")).alias("component")).where("component IS NOT NULL")
    fresh = roots.toDF("archive_id", "component").join(seats.select("archive_id"), "archive_id", "left_anti")
    rest = groups.join(touched, "component", "left_anti").select("archive_id", "component")
    return rest.unionByName(moved).unionByName(fresh)


# Relations from the strongest to the weakest.
RELATION_ORDER = ("EXACT_ARCHIVE", "EXACT_CONTENT", "VISUAL_VARIANT", "RELATED")


def relation_rank(relation):
    return F.array_position(F.array(*[F.lit(r) for r in RELATION_ORDER]), relation)


def groups_of(relations: DataFrame, usable) -> DataFrame:
    """``(archive_id, component)`` of the containers that usable edges join."""
    return connected_components(relations.where(usable).select("a", "b")).withColumnRenamed("node", "archive_id")


def edges_in_groups(relations: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations with both ends in one group, weak ones too, with its ``component``."""
    left, right = groups.toDF("a", "component"), groups.toDF("b", "_cb")
    return relations.join(left, "a").join(right, "b").where("component = _cb").drop("_cb")


def strongest_edges(edges: DataFrame) -> DataFrame:
    """``(component, relation, confidence)``: the strongest relation of a group and its greatest confidence."""
    best = edges.groupBy("component").agg(F.min(relation_rank(F.col("relation"))).alias("r"))
    ranked = edges.withColumn("r", relation_rank(F.col("relation"))).join(best, ["component", "r"])
    return ranked.groupBy("component").agg(F.min("relation").alias("relation"), F.max("confidence").alias("confidence"))


def recommended_member(edges: DataFrame) -> DataFrame:
    """``(component, archive_id)``: the winner that every edge of the group names, or null."""
    winner = F.when(F.col("recommendation").startswith("KEEP_LEFT"), F.col("a")).when(F.col("recommendation").startswith("KEEP_RIGHT"), F.col("b"))
    w = edges.withColumn("w", winner)
    one = F.bool_and(F.col("w").isNotNull()) & (F.count_distinct("w") == 1)
    return w.groupBy("component").agg(F.when(one, F.min("w")).alias("archive_id"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """``(relation, groups)``: how many groups each strongest relation has."""
    return strongest_edges(edges).groupBy("relation").agg(F.count("*").alias("groups"))


def group_details(groups: DataFrame, edges: DataFrame, containers: DataFrame) -> DataFrame:
    """``(component, members, bytes, newest, edges, list)``: a row for each group with its members as sorted structs."""
    rows = groups.join(containers.select("archive_id", "path", "file_size", "mtime_ns"), "archive_id")
    per = rows.groupBy("component").agg(
        F.count("*").alias("members"), F.sum("file_size").alias("bytes"), F.max_by("archive_id", F.struct("mtime_ns", "archive_id")).alias("newest"), F.array_sort(F.collect_list(F.struct("archive_id", "path", "file_size"))).alias("list")
    )
    n = edges.groupBy("component").agg(F.count("*").alias("edges"))
    return per.join(n, "component", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
