"""The review ledger: latest actions, snapshots, batch previews and guarded state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Review actions, and the states that a quarantine or deletion record may go to from each state.
ACTIONS = ("KEEP", "HOLD", "REMOVE_CANDIDATE")
QUARANTINE_STEPS = (("PENDING", "QUARANTINED"), ("PENDING", "FAILED"), ("QUARANTINED", "RESTORING"), ("RESTORING", "RESTORED"), ("RESTORING", "QUARANTINED"), ("RESTORING", "FAILED"))
DELETION_STEPS = (("PENDING", "DELETED"), ("PENDING", "FAILED"))
SNAPSHOT = ("archive_id", "file_size", "mtime_ns")


def latest(rows: DataFrame, key: str = "archive_id", order: str = "id") -> DataFrame:
    """The row with the greatest ``order`` of each ``key``; a map-side aggregate, so a busy key costs one row a task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def latest_by_window(rows: DataFrame, key: str = "archive_id", order: str = "id") -> DataFrame:
    """The same by row_number, whose group limit runs before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_version(facts: DataFrame, *key: str) -> DataFrame:
    """Facts of the greatest ``version`` for each key."""
    return facts.groupBy(*key).agg(F.max_by(F.struct(*facts.columns), "version").alias("_r")).select("_r.*")


def current(facts: DataFrame, containers: DataFrame) -> DataFrame:
    """Facts whose snapshot (id, size, mtime) is the container's present one."""
    return facts.join(containers.select(*SNAPSHOT), list(SNAPSHOT), "left_semi")


def stale(facts: DataFrame, containers: DataFrame) -> DataFrame:
    return facts.join(containers.select(*SNAPSHOT), list(SNAPSHOT), "left_anti")


def without_fact(containers: DataFrame, facts: DataFrame) -> DataFrame:
    """Containers that have no fact for their present snapshot, which are to be worked out."""
    return containers.join(facts.select(*SNAPSHOT), list(SNAPSHOT), "left_anti")


def review_state(ledger: DataFrame, containers: DataFrame) -> DataFrame:
    """``(archive_id, action, needs_review)``: the latest action, and whether the container has changed since.

    ``ledger(id, archive_id, action, file_size, mtime_ns)``; containers without an action have a null one.
    """
    last = latest(ledger).select("archive_id", "action", F.col("file_size").alias("_fs"), F.col("mtime_ns").alias("_mt"))
    out = containers.join(last, "archive_id", "left")
    moved = (F.col("_fs") != F.col("file_size")) | (F.col("_mt") != F.col("mtime_ns"))
    return out.select("archive_id", "action", (F.col("action").isNotNull() & F.coalesce(moved, F.lit(True))).alias("needs_review"))


def group_summaries(members: DataFrame, state: DataFrame) -> DataFrame:
    """``(component, members, needs_review)``: a group with actions of which some are out of date."""
    rows = members.join(state, "archive_id", "left")
    acted, fresh = F.col("action").isNotNull(), F.col("action").isNotNull() & ~F.coalesce("needs_review", F.lit(False))
    return rows.groupBy("component").agg(F.count("*").alias("members"), (F.bool_or(acted) & ~F.bool_and(fresh)).alias("needs_review"))


def group_tabs(members: DataFrame) -> DataFrame:
    """``(component, tab)`` from ``members(component, problem, deleted, quarantined, reviewed)``: 4, 3, 2, 1 or 0."""
    agg = members.groupBy("component").agg(F.bool_or("problem").alias("p"), F.bool_and("deleted").alias("d"), F.bool_or("quarantined").alias("q"), F.bool_and("reviewed").alias("r"))
    return agg.select("component", F.when(F.col("p"), 4).when(F.col("q"), 2).when(F.col("d"), 3).when(F.col("r"), 1).otherwise(0).alias("tab"))


def preview_actions(members: DataFrame) -> DataFrame:
    """``(bucket, n, bytes)``: what a batch would do with ``members(deleted, needs_review, action, quarantined, file_size)``."""
    bucket = (
        F.when(F.col("deleted"), "DELETED")
        .when(F.col("needs_review"), "NEEDS_REVIEW")
        .when(F.col("action") == "KEEP", "KEEP")
        .when(F.col("action") == "HOLD", "HOLD")
        .when((F.col("action") == "REMOVE_CANDIDATE") & F.col("quarantined"), "QUARANTINED")
        .when(F.col("action") == "REMOVE_CANDIDATE", "REMOVE")
        .otherwise("UNREVIEWED")
    )
    return members.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


def apply_recommendations(items: DataFrame, containers: DataFrame, ledger: DataFrame, applied: DataFrame) -> DataFrame:
    """``(set_key, archive_id, outcome)`` of ``items(set_key, archive_id, recommendation, file_size, mtime_ns)``.

    ``applied(set_key, archive_id)`` were applied before. A user's own later decision is never overruled.
    """
    now = containers.select("archive_id", F.col("file_size").alias("_fs"), F.col("mtime_ns").alias("_mt"))
    last = latest(ledger).select("archive_id", "action")
    rows = items.join(now, "archive_id", "left").join(last, "archive_id", "left")
    rows = rows.join(applied.select("set_key", "archive_id").distinct().withColumn("_done", F.lit(True)), ["set_key", "archive_id"], "left")
    same = F.coalesce((F.col("_fs") == F.col("file_size")) & (F.col("_mt") == F.col("mtime_ns")), F.lit(False))
    outcome = (
        F.when(F.col("recommendation") == "NONE", "NO_RECOMMENDATION")
        .when(~same, "CHANGED_SNAPSHOT_SKIPPED")
        .when(F.col("_done"), "ALREADY_APPLIED")
        .when(F.col("action").isNotNull(), "USER_DECISION_SKIPPED")
        .otherwise("APPLIED")
    )
    return rows.select("set_key", "archive_id", outcome.alias("outcome"))


def appended(outcomes: DataFrame, items: DataFrame) -> DataFrame:
    """The ledger rows that applied recommendations add."""
    return items.join(outcomes.where("outcome = 'APPLIED'"), ["set_key", "archive_id"], "left_semi").select("archive_id", F.col("recommendation").alias("action"), "file_size", "mtime_ns")


def keep_unreviewed(members: DataFrame, state: DataFrame) -> DataFrame:
    """``(archive_id, action)``: KEEP for the members of the groups that nobody has acted on since they last changed.

    ``members(component, archive_id, deleted, quarantine)`` of the chosen groups, ``state`` of ``review_state``. What is
    deleted, in quarantine, on its way there or failed on it is left alone; a container in several groups counts once.
    """
    away = F.col("deleted") | F.coalesce(F.col("quarantine").isin("PENDING", "QUARANTINED", "RESTORING", "FAILED"), F.lit(False))
    rows = members.where(~away).select("archive_id").distinct().join(state, "archive_id", "left")
    return rows.where(F.col("action").isNull() | F.coalesce("needs_review", F.lit(False))).select("archive_id", F.lit("KEEP").alias("action"))


def step(records: DataFrame, wanted: DataFrame, steps: tuple[tuple[str, str], ...]) -> DataFrame:
    """``records(item, state)`` after ``wanted(item, from_state, to_state)``, with ``moved``: compare and set.

    A change happens only from the state that it names, which must be the item's, and along an allowed step. Of several
    that fit the least ``to_state`` counts; those that name another state are no rivals of it. Requests without an item or
    of an item that has no record are passed over, and repeated ones are one.
    """
    allowed = F.lit(False)
    for a, b in steps:
        allowed = allowed | ((F.col("from_state") == a) & (F.col("to_state") == b))
    # one row of an item and state at most, so a busy item costs one row a task before it meets its record
    one = wanted.where(allowed).groupBy("item", F.col("from_state").alias("state")).agg(F.min("to_state").alias("to_state"))
    ok = F.col("to_state").isNotNull()
    return records.join(one, ["item", "state"], "left").select("item", F.coalesce("to_state", "state").alias("state"), ok.alias("moved"))


def active_items(quarantine: DataFrame, deletions: DataFrame) -> DataFrame:
    """Latest quarantined item of each container without a pending or finished deletion."""
    last = latest(quarantine.where("state IN ('PENDING', 'QUARANTINED', 'RESTORING')"))
    gone = deletions.where("state IN ('PENDING', 'DELETED')").select(F.col("quarantine_id").alias("id"))
    return last.join(gone, "id", "left_anti")


def quarantine_codes(members: DataFrame, ledger: DataFrame, containers: DataFrame, active: DataFrame) -> DataFrame:
    """``(archive_id, code)``: OK, or why a member may not be quarantined."""
    state = review_state(ledger, containers)
    rows = members.select("archive_id").join(state, "archive_id", "left").join(active.select("archive_id").distinct().withColumn("_a", F.lit(True)), "archive_id", "left")
    code = F.when(F.coalesce("action", F.lit("")) != "REMOVE_CANDIDATE", "NOT_REMOVE_CANDIDATE").when(F.col("needs_review"), "SNAPSHOT_CHANGED").when(F.col("_a"), "ALREADY_QUARANTINED").otherwise("OK")
    return rows.select("archive_id", code.alias("code"))


def deletion_codes(active: DataFrame, ledger: DataFrame, containers: DataFrame) -> DataFrame:
    """``(archive_id, code)`` of quarantined items ``(archive_id, state, sha256)``: OK, or why one may not be deleted."""
    rows = active.join(review_state(ledger, containers), "archive_id", "left")
    code = F.when(F.col("state") != "QUARANTINED", "NOT_QUARANTINED").when(F.coalesce("sha256", F.lit("")) == "", "NO_HASH").when(F.coalesce("action", F.lit("")) != "REMOVE_CANDIDATE", "NOT_REMOVE_CANDIDATE").when(F.col("needs_review"), "SNAPSHOT_CHANGED").otherwise("OK")
    return rows.select("archive_id", code.alias("code"))


def unresolved_profiles(profiles: DataFrame, before_version: int) -> DataFrame:
    """Newest profile of each snapshot that succeeded without a language, by an analyzer older than ``before_version``."""
    return newest_version(profiles, *SNAPSHOT).where("language = 'UNKNOWN' AND state = 'SUCCEEDED' AND error IS NULL").where(F.col("version") < before_version)


def current_sets(sets: DataFrame, generations: DataFrame) -> DataFrame:
    """Candidate sets that a group's generation names; for a group without one, those of its latest ``computed_at``."""
    named = sets.join(generations.select("component", F.explode("set_keys").alias("set_key")), ["component", "set_key"], "left_semi")
    rest = sets.join(generations.select("component").distinct(), "component", "left_anti")
    newest = rest.groupBy("component").agg(F.max("computed_at").alias("computed_at"))
    return named.unionByName(rest.join(newest, ["component", "computed_at"], "left_semi").select(*named.columns))


def review_list(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``(component, entry)``: a group's derived sets in its place; groups without sets pass through."""
    own = groups.join(sets.select("component").distinct(), "component", "left_anti").select("component", F.col("component").cast("string").alias("entry"))
    return own.unionByName(sets.select("component", F.col("set_key").alias("entry")).distinct())


def first_set_wins(targets: DataFrame) -> DataFrame:
    """Batch targets with a container in several sets only in the first."""
    return targets.groupBy("archive_id").agg(F.min("set_key").alias("set_key"))


def activity(*tables: tuple[str, DataFrame]) -> DataFrame:
    """``(archive_id, <kind>_at ...)``: last time of each kind of record ``(archive_id, at)``."""
    rows = None
    for kind, t in tables:
        part = t.select("archive_id", "at", F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("archive_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"{k}_at") for k, _ in tables])


def merge_rows(old: DataFrame, new: DataFrame, key: list[str], better: Column | None = None) -> DataFrame:
    """Upsert: new rows replace old ones of their key; with ``better`` (over ``o`` and ``n``) only where it holds."""
    value = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*value).alias("o"))
    n = new.select(*key, F.struct(*value).alias("n"))
    both = o.join(n, key, "full")
    take = F.col("o").isNull() | (F.col("n").isNotNull() & (F.lit(True) if better is None else F.coalesce(better, F.lit(False))))
    return both.select(*key, F.when(take, F.col("n")).otherwise(F.col("o")).alias("v")).select(*key, "v.*")


def merge_fingerprints(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Merge ``(..., coverage, pixel, dhash)``: FULL never falls back to PROBE, and a null hash keeps the old one."""
    both = old.select(*key, F.struct("coverage", "pixel", "dhash").alias("o")).join(new.select(*key, F.struct("coverage", "pixel", "dhash").alias("n")), key, "full")
    full = (F.col("o.coverage") == "FULL") | (F.col("n.coverage") == "FULL")
    return both.select(*key, F.when(F.coalesce(full, F.lit(False)), "FULL").otherwise("PROBE").alias("coverage"), F.coalesce("n.pixel", "o.pixel").alias("pixel"), F.coalesce("n.dhash", "o.dhash").alias("dhash"))
