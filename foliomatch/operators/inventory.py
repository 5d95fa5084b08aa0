"""The inventory of containers: counts, progress, coverage, scopes, profiles, replacement of an index, and texts for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.functions.fingerprints import probe_slots
from foliomatch.functions.text import file_size_text
from foliomatch.operators.editions import container_language
from foliomatch.operators.matching import usable_edge
from foliomatch.operators.review import ACTIONS, SNAPSHOT, latest

# Failures that reading again cannot mend, and those that it may.
STABLE_ERRORS = ("AMBIGUOUS_ENTRY_NAME", "CORRUPT_ARCHIVE", "ENCRYPTED_UNSUPPORTED", "IMAGE_BYTE_LIMIT", "IMAGE_PIXEL_LIMIT", "UNSUPPORTED_FORMAT")
RETRYABLE_ERRORS = ("ACCESS_DENIED", "ARCHIVE_CHANGED", "ENTRY_CHANGED", "FILE_NOT_FOUND", "SEVEN_ZIP_FAILED", "SEVEN_ZIP_NOT_FOUND")
# Fixed value: what cached evidence says if nothing could be compared.
NOTHING_ALIGNED = "no aligned pages"
# States of jobs and of containers in reports.
JOB_STATES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
REPORT_STATES = ("indexed", "failed", "skipped", "missing", "pending")
# Texts of reasons and states of recommendations.
REASON_TEXTS = {
    "DATED_SERIES_TITLE": "날짜·갱신 표기를 제외한 제목이 같은 갱신판 후보입니다.",
    "IDENTICAL_ARCHIVE_SHA256": "압축 파일 SHA-256 값이 같습니다.",
    "ALL_PIXEL_SHA256_IN_ORDER": "전체 페이지의 픽셀 데이터가 순서대로 같습니다.",
    "LEFT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER": "{left_label}의 대표 페이지 해상도가 더 큽니다.",
    "RIGHT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER": "{right_label}의 대표 페이지 해상도가 더 큽니다.",
    "MEDIAN_PIXEL_AREA_DIFFERENCE_BELOW_15_PERCENT": "대표 페이지 해상도 차이가 추천 기준인 15%보다 작습니다.",
    "NO_MATCHED_PAGE_RESOLUTION_EVIDENCE": "대표 페이지 해상도 근거가 부족합니다.",
    "PROBE_HASH_NEAR": "대표 이미지 지문이 유사합니다.",
}
STATUS_TEXTS = {
    "RECOMMENDED": "추천 완료",
    "UNKNOWN": "추천 상태를 확인할 수 없음",
    "ANALYSIS_REQUIRED": "검토 필요 · 정밀분석 필요",
    "UNCERTAIN": "검토 필요 · 근거 부족",
    "CONFLICT": "검토 필요 · 기준 충돌",
    "NONE": "검토 필요 · 확실한 우위 없음",
}
CRITERION_TEXTS = {"LEFT_BETTER": "우세", "RIGHT_BETTER": "불리", "TIE": "동일", "UNKNOWN": "분석 없음", "MIXED": "판단 엇갈림"}
UNKNOWN_STATUS, NO_CRITERION, NO_RESOLUTION, PAGES = "추천 상태를 확인할 수 없음", "정보 없음", "해상도 정보 없음", "쪽"


def input_counts(containers: DataFrame) -> DataFrame:
    """``(containers, images)``, one row: the indexed containers of ``containers(state, image_count)`` and their images."""
    return containers.where("state = 'INDEXED'").agg(F.count("*").alias("containers"), F.coalesce(F.sum("image_count"), F.lit(0)).cast("long").alias("images"))


def job_progress(jobs: DataFrame) -> DataFrame:
    """``(run_id, total, pending, running, succeeded, failed, cancelled)`` of ``jobs(run_id, status)``."""
    return jobs.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in JOB_STATES])


def report_summary(containers: DataFrame) -> DataFrame:
    """``(total, indexed, failed, skipped, missing, pending)``, one row, of ``containers(state)`` in any case."""
    return containers.agg(F.count("*").alias("total"), *[F.count_if(F.lower("state") == s).alias(s) for s in REPORT_STATES])


def full_coverage(units: DataFrame, cached: DataFrame) -> DataFrame:
    """``(archive_id, complete)`` for every container of ``units(archive_id, pos)`` or ``cached(archive_id, pos, coverage)``.

    Complete are those that have units, whose positions are just those with a FULL fingerprint.
    """
    have = units.select("archive_id", "pos").distinct().withColumn("unit", F.lit(1))
    full = cached.where("coverage = 'FULL'").select("archive_id", "pos").distinct().withColumn("full", F.lit(1))
    both = have.join(full, ["archive_id", "pos"], "full")
    return both.groupBy("archive_id").agg((F.bool_and(F.col("unit").isNotNull() & F.col("full").isNotNull())).alias("complete"))


def seeded(containers: DataFrame, seeds: DataFrame) -> DataFrame:
    """Containers that are an end of some seed, which alone go on to full fingerprints."""
    return containers.join(seeds.select(F.explode(F.array("a", "b")).alias("archive_id")).distinct(), "archive_id", "left_semi")


def in_scope(rows: DataFrame, keys: DataFrame, key: str = "component") -> DataFrame:
    """Rows of the affected keys alone."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def to_compare_again(relations: DataFrame, cached: DataFrame) -> DataFrame:
    """``(a, b)``: usable relations without a cached comparison of the same snapshots, or whose evidence says that nothing
    could be aligned. ``cached(a, b, evidence)``."""
    rows = relations.where(usable_edge()).select("a", "b").join(cached.select("a", "b", "evidence", F.lit(True).alias("_met")), ["a", "b"], "left")
    return rows.where(F.col("_met").isNull() | F.coalesce(F.col("evidence").contains(NOTHING_ALIGNED), F.lit(False))).select("a", "b").distinct()


def page_hashes(containers: DataFrame, fingerprints: DataFrame, images: DataFrame) -> DataFrame:
    """``(archive_id, pos, pixel)`` of indexed containers whose present snapshot was fingerprinted by the same version.

    ``containers(archive_id, state, file_size, mtime_ns)``, ``fingerprints(archive_id, version, file_size, mtime_ns)``,
    ``images(archive_id, version, pos, coverage, state, pixel)``; images must be FULL, SUCCEEDED and have a hash.
    """
    live = fingerprints.join(containers.where("state = 'INDEXED'").select(*SNAPSHOT), list(SNAPSHOT), "left_semi").select("archive_id", "version")
    whole = images.where("coverage = 'FULL' AND state = 'SUCCEEDED' AND pixel IS NOT NULL")
    return whole.join(live, ["archive_id", "version"], "left_semi").select("archive_id", "pos", "pixel")


def size_collisions(containers: DataFrame, size: str = "file_size") -> DataFrame:
    """Containers that share their size with another one, with ``n``, how many have it; a null size is shared with nobody.

    Sizes are counted by partial aggregates and joined back, so one size of very many containers is a skewed join that
    adaptive execution may split, and never a window.
    """
    several = containers.groupBy(size).agg(F.count("*").alias("n")).where("n > 1")
    return containers.join(several, size)


def candidate_evidence(containers: DataFrame, fingerprints: DataFrame, images: DataFrame, version: int) -> DataFrame:
    """``(archive_id, file_size, mtime_ns, sha256, slot, pos, pixel)``: the probes that candidates are sought with.

    ``containers(archive_id, state, file_size, mtime_ns)`` that are indexed, their ``fingerprints(archive_id, version,
    file_size, mtime_ns, sha256)`` of this analyzer version and of the present snapshot, and of ``images(archive_id,
    version, pos, state, pixel)`` those at the probed places of the container's images. A probe that failed is left out,
    a container without images has none.
    """
    live = containers.where("state = 'INDEXED'").select(*SNAPSHOT)
    own = fingerprints.where(F.col("version") == version).join(live, list(SNAPSHOT), "left_semi").select(*SNAPSHOT, "sha256")
    placed = images.where(F.col("version") == version).withColumn("_at", F.row_number().over(Window.partitionBy("archive_id").orderBy("pos")) - 1)
    n = images.where(F.col("version") == version).groupBy("archive_id").agg(F.count("*").cast("int").alias("n"))
    slots = n.select("archive_id", F.inline(probe_slots(F.col("n"))).alias("slot", "_at"))
    probes = placed.join(slots, ["archive_id", "_at"]).where("state = 'SUCCEEDED' AND pixel IS NOT NULL")
    return own.join(probes.select("archive_id", "slot", "pos", "pixel"), "archive_id")


def still_current(evidence: DataFrame, containers: DataFrame) -> DataFrame:
    """Evidence whose container is still there, indexed and unchanged in a later state of ``containers``."""
    return evidence.join(containers.where("state = 'INDEXED'").select(*SNAPSHOT), list(SNAPSHOT), "left_semi")


def numbered(members: DataFrame) -> DataFrame:
    """Members with ``number int``, their place by id in the group."""
    return members.withColumn("number", F.row_number().over(Window.partitionBy("component").orderBy("archive_id")))


def precision_profiles(containers: DataFrame, evidence: DataFrame, hints: DataFrame, failures: DataFrame) -> DataFrame:
    """``(archive_id, file_size, mtime_ns, state, sample_count, language, confidence, error)`` for each container.

    ``evidence`` is ``page_language``'s, ``hints(archive_id, languages)`` come from file names, ``failures(archive_id,
    error)`` name what went wrong. Without pages a profile has FAILED; without text recognition its language is unknown.
    """
    n = evidence.groupBy("archive_id").agg(F.count("*").cast("int").alias("sample_count"))
    language = container_language(evidence, hints).select("archive_id", "language", "confidence")
    rows = containers.select(*SNAPSHOT).join(n, "archive_id", "left").join(language, "archive_id", "left").join(failures.select("archive_id", "error"), "archive_id", "left")
    blind = F.coalesce(F.col("error") == "OCR_UNAVAILABLE", F.lit(False)) | F.col("language").isNull()
    some = F.coalesce("sample_count", F.lit(0)) > 0
    return rows.select(
        *SNAPSHOT, F.when(some, "SUCCEEDED").otherwise("FAILED").alias("state"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(blind, "UNKNOWN").otherwise(F.col("language")).alias("language"), F.when(blind, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("error", F.when(~some, F.lit("NO_USABLE_PAGES"))).alias("error"),
    )


def language_changes(profiles: DataFrame, evidence: DataFrame, hints: DataFrame) -> DataFrame:
    """``(archive_id, language, confidence)`` of profiles whose stored pages now say another language; no page is read."""
    now = container_language(evidence, hints).select("archive_id", "language", "confidence")
    old = profiles.where("state = 'SUCCEEDED'").select("archive_id", F.col("language").alias("_old"))
    return now.join(old, "archive_id").where(~F.col("language").eqNullSafe(F.col("_old"))).drop("_old")


def preview_recommendations(items: DataFrame, containers: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(outcome, n)``: what applying ``items(component, archive_id, status, recommendation, file_size, mtime_ns)`` would do.

    ``ledger(id, archive_id, action, file_size, mtime_ns, applied, reset)``: a last action that a recommendation wrote or
    a reset leaves an item eligible, a user's own does not, and nothing happens to a container that has changed.
    """
    now = containers.select("archive_id", F.col("file_size").alias("_fs"), F.col("mtime_ns").alias("_mt"))
    last = latest(ledger).select("archive_id", F.struct(F.col("file_size").alias("fs"), F.col("mtime_ns").alias("mt"), (F.col("applied") | F.col("reset")).alias("own")).alias("l"))
    rows = items.join(now, "archive_id", "left").join(last, "archive_id", "left")
    same = F.coalesce((F.col("_fs") == F.col("file_size")) & (F.col("_mt") == F.col("mtime_ns")), F.lit(False))
    stale = F.col("l").isNotNull() & ~F.coalesce((F.col("l.fs") == F.col("_fs")) & (F.col("l.mt") == F.col("_mt")), F.lit(False))
    outcome = (
        F.when((F.col("status") != "RECOMMENDED") | ~F.col("recommendation").isin("KEEP", "REMOVE_CANDIDATE"), "NO_RECOMMENDATION")
        .when(~same | stale, "CHANGED_SNAPSHOT_SKIPPED")
        .when(F.col("l").isNotNull() & ~F.coalesce("l.own", F.lit(False)), "USER_DECISION_SKIPPED")
        .otherwise(F.col("recommendation"))
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def verified_actions(requests: DataFrame, members: DataFrame, containers: DataFrame) -> DataFrame:
    """``(request, archive_id, action, file_size, mtime_ns, error)``: the ledger rows that ``requests`` add, or why not.

    ``requests(request, component, archive_id, action, file_size, mtime_ns)``: with an id the named snapshot must be the
    present one; with a null id all members of the group get the action, KEEP or HOLD, each with its present snapshot.
    """
    one = requests.where("archive_id IS NOT NULL").join(members.select("component", "archive_id", F.lit(True).alias("_in")), ["component", "archive_id"], "left")
    every = requests.where("archive_id IS NULL").select("request", "component", "action").join(members.select("component", "archive_id"), "component", "left")
    every = every.select("request", "archive_id", "action", F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_m"), F.col("archive_id").isNotNull().alias("_in"), F.lit(True).alias("_group"))
    rows = one.select("request", "archive_id", "action", F.col("file_size").alias("_s"), F.col("mtime_ns").alias("_m"), "_in", F.lit(False).alias("_group")).unionByName(every)
    rows = rows.join(containers.select(*SNAPSHOT), "archive_id", "left")
    moved = ~F.col("_group") & ~F.coalesce((F.col("_s") == F.col("file_size")) & (F.col("_m") == F.col("mtime_ns")), F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "UNKNOWN_ACTION")
        .when(F.col("_group") & ~F.col("action").isin("KEEP", "HOLD"), "NOT_FOR_GROUPS")
        .when(~F.coalesce("_in", F.lit(False)) | F.col("file_size").isNull(), "NO_SUCH_MEMBER")
        .when(moved, "SNAPSHOT_CHANGED")
    )
    return rows.select("request", "archive_id", "action", "file_size", "mtime_ns", error.alias("error"))


def reset_actions(sets: DataFrame, keys: DataFrame, containers: DataFrame) -> DataFrame:
    """Ledger rows ``(archive_id, action, file_size, mtime_ns, reset)`` that put the members of the named sets on HOLD, each
    container once, marked as a reset."""
    wanted = in_scope(sets, keys, "set_key").select("archive_id").distinct()
    return wanted.join(containers.select(*SNAPSHOT), "archive_id").select("archive_id", F.lit("HOLD").alias("action"), "file_size", "mtime_ns", F.lit(True).alias("reset"))


def replace_index(members: DataFrame, containers: DataFrame, listed: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and containers after a batch: all members of the listed containers are replaced, and these become INDEXED.

    ``listed(archive_id, ...)`` like ``members``; ``inventory(archive_id, n_members, n_images, signature)`` one row each;
    ``containers(archive_id, state, n_members, n_images, signature, ...)``.
    """
    batch = inventory.select("archive_id", F.struct("n_members", "n_images", "signature").alias("_new"))
    left = members.join(batch, "archive_id", "left_anti").unionByName(listed.join(batch, "archive_id", "left_semi"))
    rows = containers.join(batch, "archive_id", "left")
    new = {"state": F.when(F.col("_new").isNotNull(), "INDEXED").otherwise(F.col("state"))}
    new |= {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("n_members", "n_images", "signature")}
    return left, rows.select(*[new.get(c, F.col(c)).alias(c) for c in containers.columns])


def input_fingerprint(*values: Column) -> Column:
    """SHA-256 of everything that a decision depends on, as JSON."""
    return F.sha2(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), 256)


def unclaimed(work: DataFrame, runs: DataFrame) -> DataFrame:
    """Work whose ``fingerprint`` no completed run has; running it again changes nothing."""
    return work.join(runs.where("state = 'COMPLETED'").select("fingerprint").distinct(), "fingerprint", "left_anti")


def to_retry(results: DataFrame) -> DataFrame:
    """Results that are worth another try: their error is none of ``STABLE_ERRORS``, which are kept as they are."""
    return results.where(F.col("error").isNotNull() & ~F.col("error").isin(*STABLE_ERRORS))


def _text(value: Column, texts: dict[str, str], other: str | None = None) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), value)
    return known if other is None else F.coalesce(known, F.lit(other))


def reason_text(reason: Column, left_label: Column, right_label: Column) -> Column:
    """The display text of an edge's reason with the labels of its ends; null for a reason without one."""
    return F.replace(F.replace(_text(reason, REASON_TEXTS), F.lit("{left_label}"), left_label), F.lit("{right_label}"), right_label)


def status_text(status: Column) -> Column:
    return _text(status, STATUS_TEXTS, UNKNOWN_STATUS)


def criterion_text(result: Column) -> Column:
    return _text(result, CRITERION_TEXTS, NO_CRITERION)


def member_cells(members: DataFrame) -> DataFrame:
    """``(component, archive_id, name, specs, resolution, size, pages, mtime)``: the cells of a table of members.

    ``members(component, archive_id, file_name, color_text, mosaic_text, file_size, page_count, mtime_ns, width, height)``.
    Unknown values are dashes; times are in the session's zone.
    """
    size, known = file_size_text(F.col("file_size")), F.col("width").isNotNull() & F.col("height").isNotNull()
    resolution = lambda mark: F.concat(F.col("width").cast("string"), F.lit(mark), F.col("height").cast("string"))
    pages = F.coalesce("page_count", F.lit(0)).cast("string")
    at = F.date_format(F.timestamp_seconds(F.floor(F.col("mtime_ns") / 1_000_000_000)), "yyyy-MM-dd HH:mm:ss")
    return members.select(
        "component", "archive_id", F.concat("file_name", F.lit("\n"), "color_text", F.lit(" · "), "mosaic_text").alias("name"),
        F.concat(size, F.lit(" · "), pages, F.lit(PAGES + "\n"), F.when(known, resolution(" × ")).otherwise(NO_RESOLUTION)).alias("specs"),
        F.when(known, resolution("x")).otherwise("-").alias("resolution"), size.alias("size"),
        F.coalesce(F.col("page_count").cast("string"), F.lit("-")).alias("pages"), F.when(F.col("mtime_ns") > 0, at).otherwise("-").alias("mtime"),
    )
