"""Registered queries over the inventory: orders stand for containers, their line items for units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.functions import fingerprints as fp
from foliomatch.functions import text as tx
from foliomatch.operators import inventory as iv
from foliomatch.operators import recommend as rc
from foliomatch.operators import review as rv
from foliomatch.operators import tables as tb
from foliomatch.sources import bindings as bi

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


ORDERS = """
c AS (SELECT o_orderkey AS archive_id, o_custkey AS component, CASE o_orderstatus WHEN 'F' THEN 'INDEXED' WHEN 'O' THEN 'FAILED' ELSE 'PENDING' END AS state,
             CAST(round(o_totalprice) AS BIGINT) AS file_size, o_orderkey * 1000000007 AS mtime_ns FROM orders),
u AS (SELECT l_orderkey AS archive_id, CAST(l_linenumber AS INTEGER) AS pos, l_partkey, l_suppkey FROM lineitem),
n AS (SELECT archive_id, count(*) AS image_count FROM u GROUP BY 1),
"""


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "INDEXED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("PENDING")
    o = bi.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("archive_id"), F.col("o_custkey").alias("component"), status.alias("state"), F.round("o_totalprice").cast("long").alias("file_size"), (F.col("o_orderkey") * 1_000_000_007).alias("mtime_ns"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive_id"), F.col("l_linenumber").cast("int").alias("pos"), "l_partkey", "l_suppkey")


def _sql(last: str) -> str:
    return "WITH " + ORDERS.rstrip().rstrip(",") + "\n" + last


@query(_sql("SELECT count(*) AS containers, CAST(coalesce(sum(coalesce(image_count, 0)), 0) AS BIGINT) AS images FROM c LEFT JOIN n USING (archive_id) WHERE state = 'INDEXED'"))
def a01_input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _units(spark, sf_dir).groupBy("archive_id").agg(F.count("*").alias("image_count"))
    return iv.input_counts(_containers(spark, sf_dir).join(n, "archive_id", "left"))


_STATUS = "['PENDING', 'RUNNING', 'SUCCEEDED', 'FAILED', 'CANCELLED'][CAST(archive_id % 5 AS INTEGER) + 1]"


@query(_sql(f"SELECT component AS run_id, count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE {_STATUS} = '{s}') AS {s.lower()}''' for s in iv.JOB_STATES)} FROM c GROUP BY 1"))
def a06_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in iv.JOB_STATES]), (F.col("archive_id") % 5 + 1).cast("int"))
    return iv.job_progress(_containers(spark, sf_dir).select(F.col("component").alias("run_id"), status.alias("status")))


@query(_sql(f"SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE lower(state) = '{s}') AS {s}''' for s in iv.REPORT_STATES)} FROM c"))
def k01_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.report_summary(_containers(spark, sf_dir))


_FULL = "CASE WHEN l_suppkey % 9 = 0 THEN 'PROBE' ELSE 'FULL' END"


@query(_sql(f", p AS (SELECT archive_id, pos, bool_or({_FULL} = 'FULL') AS whole FROM u GROUP BY ALL) SELECT archive_id, bool_and(whole) AS complete FROM p GROUP BY 1"))
def w07_full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    cached = units.withColumn("coverage", F.when(F.col("l_suppkey") % 9 == 0, "PROBE").otherwise("FULL"))
    return iv.full_coverage(units, cached)


@query(_sql(", s AS (SELECT DISTINCT l_partkey, min(archive_id) AS a, max(archive_id) AS b FROM u GROUP BY 1) SELECT archive_id, state FROM c WHERE archive_id IN (SELECT a FROM s UNION SELECT b FROM s)"))
def c21_seeded_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _units(spark, sf_dir).groupBy("l_partkey").agg(F.min("archive_id").alias("a"), F.max("archive_id").alias("b"))
    return iv.seeded(_containers(spark, sf_dir), seeds).select("archive_id", "state")


@query(_sql("SELECT archive_id, component FROM c WHERE component IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def w11_affected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = bi.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("component"))
    return iv.in_scope(_containers(spark, sf_dir), keys).select("archive_id", "component")


_RELATION = "CASE WHEN archive_id % 4 = 0 THEN 'VISUAL_VARIANT' ELSE 'RELATED' END"


@query(_sql(f"""SELECT archive_id AS a, archive_id + 1 AS b FROM c JOIN n USING (archive_id)
WHERE ({_RELATION} <> 'RELATED' OR (image_count >= 2 AND file_size % 100 >= 50)) AND (state = 'PENDING' OR state = 'FAILED')"""))
def w06_to_compare_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _units(spark, sf_dir).groupBy("archive_id").agg(F.count("*").alias("matched"))
    rows = _containers(spark, sf_dir).join(n, "archive_id")
    pair = [F.col("archive_id").alias("a"), (F.col("archive_id") + 1).alias("b")]
    relations = rows.select(*pair, F.when(F.col("archive_id") % 4 == 0, "VISUAL_VARIANT").otherwise("RELATED").alias("relation"), "matched", ((F.col("file_size") % 100) / 100.0).alias("confidence"))
    cached = rows.where("state <> 'PENDING'").select(*pair, F.when(F.col("state") == "FAILED", "[\"no aligned pages\"]").otherwise("[]").alias("evidence"))
    return iv.to_compare_again(relations, cached)


@query(_sql("SELECT archive_id, pos, CAST(l_partkey AS VARCHAR) AS pixel FROM u JOIN c USING (archive_id) WHERE state = 'INDEXED' AND c.archive_id % 7 <> 3 AND l_suppkey % 9 <> 0 AND l_suppkey % 8 <> 0"))
def d15_page_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, s = _containers(spark, sf_dir), F.col("l_suppkey")
    prints = containers.select("archive_id", F.lit(2).alias("version"), (F.col("file_size") + F.when(F.col("archive_id") % 7 == 3, 1).otherwise(0)).alias("file_size"), "mtime_ns")
    images = _units(spark, sf_dir).select("archive_id", F.lit(2).alias("version"), "pos", F.when(s % 9 == 0, "PROBE").otherwise("FULL").alias("coverage"), F.when(s % 8 == 0, "FAILED").otherwise("SUCCEEDED").alias("state"), F.col("l_partkey").cast("string").alias("pixel"))
    return iv.page_hashes(containers, prints, images)


@query(_sql("SELECT archive_id, CAST(row_number() OVER (PARTITION BY component ORDER BY archive_id) AS INTEGER) AS number FROM c"))
def v12_numbered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.numbered(_containers(spark, sf_dir)).select("archive_id", "number")


@query("""WITH d AS (SELECT doc_id, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS english, len(regexp_replace(text, '[\\P{L}\\x00-\\x7F]', '', 'g')) AS other FROM documents)
SELECT doc_id AS archive_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS sample_count,
       CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'UNKNOWN' WHEN lang <> 'ENGLISH' AND doc_id % 3 = 0 THEN 'UNKNOWN' WHEN lang = 'ENGLISH' AND doc_id % 3 = 1 THEN 'UNKNOWN' ELSE lang END AS language,
       CASE WHEN doc_id % 7 = 0 THEN 'OCR_UNAVAILABLE' WHEN doc_id % 5 = 0 THEN 'NO_USABLE_PAGES' ELSE '' END AS error
FROM (SELECT doc_id, CASE WHEN greatest(english, other) < 4 THEN 'UNKNOWN' WHEN english >= other THEN CASE WHEN other >= 4 AND english < 1.5 * other THEN 'UNKNOWN' ELSE 'ENGLISH' END
                          WHEN english >= 4 AND other < 1.5 * english THEN 'UNKNOWN' ELSE 'OTHER' END AS lang FROM d)""")
def a11_precision_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliomatch.operators import editions as ed

    d = bi.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive_id"), F.lit(0).alias("pos"), "text", F.lit(1).alias("file_size"), F.lit(1).alias("mtime_ns"))
    i = F.col("archive_id")
    named = F.when(i % 3 == 0, F.array(F.lit("ENGLISH"))).when(i % 3 == 1, F.array(F.lit("OTHER"))).otherwise(F.array().cast("array<string>"))
    hints = d.select("archive_id", named.alias("languages"))
    failures = d.select("archive_id", F.when(i % 7 == 0, "OCR_UNAVAILABLE").alias("error"))
    # every fifth container has no pages of its own: they are some other's
    pages = ed.page_language(d.withColumn("archive_id", F.when(i % 5 != 0, i).otherwise(-1 - i)))
    out = iv.precision_profiles(d, pages, hints, failures)
    return out.select("archive_id", "state", "sample_count", "language", F.coalesce("error", F.lit("")).alias("error"))


_LAST = """
l AS (SELECT user_id AS archive_id, max(event_id) AS id FROM events GROUP BY 1),
i AS (SELECT c.archive_id, CASE WHEN c.archive_id % 5 = 0 THEN 'NONE' ELSE 'RECOMMENDED' END AS status, CASE WHEN c.archive_id % 2 = 0 THEN 'KEEP' ELSE 'REMOVE_CANDIDATE' END AS rec,
             c.archive_id % 6 = 1 AS moved, l.id IS NOT NULL AS acted, l.id % 3 = 0 AS stale, l.id % 2 = 0 AS own FROM c LEFT JOIN l USING (archive_id))
"""


@query(_sql("," + _LAST + "SELECT CASE WHEN status <> 'RECOMMENDED' THEN 'NO_RECOMMENDATION' WHEN moved OR (acted AND stale) THEN 'CHANGED_SNAPSHOT_SKIPPED' WHEN acted AND NOT own THEN 'USER_DECISION_SKIPPED' ELSE rec END AS outcome, count(*) AS n FROM i GROUP BY 1"))
def a14_recommendation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, i = _containers(spark, sf_dir), F.col("archive_id")
    items = containers.select("component", "archive_id", F.when(i % 5 == 0, "NONE").otherwise("RECOMMENDED").alias("status"), F.when(i % 2 == 0, "KEEP").otherwise("REMOVE_CANDIDATE").alias("recommendation"), (F.col("file_size") + F.when(i % 6 == 1, 1).otherwise(0)).alias("file_size"), "mtime_ns")
    e = bi.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("archive_id")).join(containers.select("archive_id", "file_size", "mtime_ns"), "archive_id")
    n = F.col("id")
    ledger = e.select("id", "archive_id", F.lit("KEEP").alias("action"), (F.col("file_size") + F.when(n % 3 == 0, 1).otherwise(0)).alias("file_size"), "mtime_ns", (n % 4 == 0).alias("applied"), (n % 4 == 2).alias("reset"))
    return iv.preview_recommendations(items, containers, ledger)


@query(_sql("""SELECT 'one' || archive_id AS request, archive_id, ['KEEP', 'HOLD', 'REMOVE_CANDIDATE', 'DROP'][CAST(archive_id % 4 AS INTEGER) + 1] AS action, CASE WHEN archive_id % 4 = 3 THEN 'UNKNOWN_ACTION' WHEN archive_id % 9 = 0 THEN 'NO_SUCH_MEMBER' WHEN archive_id % 6 = 1 THEN 'SNAPSHOT_CHANGED' ELSE '' END AS error FROM c
UNION ALL SELECT 'all' || component, archive_id, ['KEEP', 'HOLD', 'REMOVE_CANDIDATE'][CAST(component % 3 AS INTEGER) + 1], CASE WHEN component % 3 = 2 THEN 'NOT_FOR_GROUPS' ELSE '' END FROM c"""))
def d01_verified_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, i, g = _containers(spark, sf_dir), F.col("archive_id"), F.col("component")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    one = containers.select(F.concat(F.lit("one"), i.cast("string")).alias("request"), F.when(i % 9 == 0, -1).otherwise(g).alias("component"), "archive_id", pick((*rv.ACTIONS, "DROP"), i).alias("action"), (F.col("file_size") + F.when(i % 6 == 1, 1).otherwise(0)).alias("file_size"), "mtime_ns")
    every = containers.select(g).distinct().select(F.concat(F.lit("all"), g.cast("string")).alias("request"), "component", F.lit(None).cast("long").alias("archive_id"), pick(rv.ACTIONS, g).alias("action"), F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("long").alias("mtime_ns"))
    out = iv.verified_actions(one.unionByName(every), containers.select("component", "archive_id"), containers)
    return out.select("request", "archive_id", "action", F.coalesce("error", F.lit("")).alias("error"))


@query(_sql("SELECT archive_id, 'HOLD' AS action, file_size, mtime_ns, true AS reset FROM c WHERE component IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def d04_reset_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = _containers(spark, sf_dir)
    keys = bi.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("set_key"))
    return iv.reset_actions(containers.select(F.col("component").alias("set_key"), "archive_id"), keys, containers)


@query(_sql("""SELECT archive_id, CASE WHEN state = 'FAILED' THEN 'INDEXED' ELSE state END AS state, CASE WHEN state = 'FAILED' THEN image_count ELSE 0 END AS n_members,
CASE WHEN state = 'FAILED' THEN 'new' ELSE 'old' END AS signature, CASE WHEN state = 'FAILED' THEN (SELECT count(*) FROM u WHERE u.archive_id = c.archive_id) ELSE 1 END AS listed FROM c JOIN n USING (archive_id)"""))
def k05_replaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _units(spark, sf_dir).groupBy("archive_id").agg(F.count("*").alias("n_members"))
    known = _containers(spark, sf_dir).join(n.select("archive_id"), "archive_id").withColumns({"n_members": F.lit(0).cast("long"), "n_images": F.lit(0).cast("long"), "signature": F.lit("old")})
    failed = known.where("state = 'FAILED'").select("archive_id")
    inventory = n.join(failed, "archive_id", "left_semi").select("archive_id", "n_members", F.lit(0).cast("long").alias("n_images"), F.lit("new").alias("signature"))
    members, containers = iv.replace_index(known.select("archive_id", F.lit(0).alias("pos")), known, _units(spark, sf_dir).select("archive_id", "pos"), inventory)
    listed = members.groupBy("archive_id").agg(F.count("*").alias("listed"))
    return containers.join(listed, "archive_id").select("archive_id", "state", "n_members", "signature", "listed")


@query(_sql("SELECT archive_id FROM c WHERE NOT (component % 3 = 0)"))
def z03_unclaimed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = _containers(spark, sf_dir)
    work = containers.select("archive_id", "component", iv.input_fingerprint(F.col("component"), F.col("archive_id"), F.col("file_size")).alias("fingerprint"))
    runs = work.select("fingerprint", F.when(F.col("component") % 3 == 0, "COMPLETED").otherwise("FAILED").alias("state"))
    return iv.unclaimed(work, runs).select("archive_id")


_ERROR = "['CORRUPT_ARCHIVE', 'ACCESS_DENIED', 'ARCHIVE_CHANGED', 'IMAGE_BYTE_LIMIT', NULL][CAST(archive_id % 5 AS INTEGER) + 1]"


@query(_sql(f"SELECT archive_id, {_ERROR} AS error FROM c WHERE {_ERROR} IN ('ACCESS_DENIED', 'ARCHIVE_CHANGED')"))
def z04_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.element_at(F.array(F.lit("CORRUPT_ARCHIVE"), F.lit("ACCESS_DENIED"), F.lit("ARCHIVE_CHANGED"), F.lit("IMAGE_BYTE_LIMIT"), F.lit(None)), (F.col("archive_id") % 5 + 1).cast("int"))
    return iv.to_retry(_containers(spark, sf_dir).select("archive_id", error.alias("error")))


@query("""WITH d AS (SELECT doc_id, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS english, len(regexp_replace(text, '[\\P{L}\\x00-\\x7F]', '', 'g')) AS other FROM documents),
n AS (SELECT doc_id, CASE WHEN greatest(english, other) < 4 THEN 'UNKNOWN' WHEN english >= other THEN CASE WHEN other >= 4 AND english < 1.5 * other THEN 'UNKNOWN' ELSE 'ENGLISH' END
                          WHEN english >= 4 AND other < 1.5 * english THEN 'UNKNOWN' ELSE 'OTHER' END AS language FROM d)
SELECT doc_id AS archive_id, language FROM n WHERE language <> CASE WHEN doc_id % 2 = 0 THEN 'ENGLISH' ELSE 'KOREAN' END""")
def z05_language_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliomatch.operators import editions as ed

    d = bi.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive_id"), F.lit(0).alias("pos"), "text")
    profiles = d.select("archive_id", F.lit("SUCCEEDED").alias("state"), F.when(F.col("archive_id") % 2 == 0, "ENGLISH").otherwise("KOREAN").alias("language"))
    none = d.select("archive_id", F.array().cast("array<string>").alias("languages"))
    return iv.language_changes(profiles, ed.page_language(d), none).select("archive_id", "language")


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


@query(_sql(f""", r(code, t) AS (VALUES {_values(iv.REASON_TEXTS)}), s(code, t) AS (VALUES {_values(iv.STATUS_TEXTS)}),
k AS (SELECT archive_id, [{', '.join(f"'{x}'" for x in (*iv.REASON_TEXTS, 'OTHER'))}][CAST(archive_id % 9 AS INTEGER) + 1] AS reason, [{', '.join(f"'{x}'" for x in (*iv.STATUS_TEXTS, 'OTHER'))}][CAST(archive_id % 7 AS INTEGER) + 1] AS status FROM c)
SELECT archive_id, coalesce(replace(replace(r.t, '{{left_label}}', '1'), '{{right_label}}', '2'), '') AS reason, coalesce(s.t, '추천 상태를 확인할 수 없음') AS status FROM k LEFT JOIN r ON r.code = reason LEFT JOIN s ON s.code = status"""))
def p18_display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("archive_id") % len(values) + 1).cast("int"))
    reason = iv.reason_text(pick((*iv.REASON_TEXTS, "OTHER")), F.lit("1"), F.lit("2"))
    return _containers(spark, sf_dir).select("archive_id", F.coalesce(reason, F.lit("")).alias("reason"), iv.status_text(pick((*iv.STATUS_TEXTS, "OTHER"))).alias("status"))


@query("""SELECT p_partkey AS archive_id, p_name || chr(10) || p_brand || ' · ' || p_type AS name,
       CASE WHEN p_partkey % 3 = 0 THEN format('{:,} B', CAST(p_size AS BIGINT)) ELSE format('{:.1f} KiB', CAST(p_size AS DOUBLE)) END || ' · ' || CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END || '쪽' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '해상도 정보 없음' ELSE p_size || ' × ' || p_partkey END AS specs,
       CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE p_size || 'x' || p_partkey END AS resolution, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS pages, CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE 'at' END AS mtime FROM part""")
def p23_member_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = bi.table(spark, sf_dir, "part"), F.col("p_partkey")
    members = p.select(
        F.lit(1).alias("component"), k.alias("archive_id"), F.col("p_name").alias("file_name"), F.col("p_brand").alias("color_text"), F.col("p_type").alias("mosaic_text"), F.when(k % 3 == 0, F.col("p_size")).otherwise(F.col("p_size") * 1024).alias("file_size"),
        F.when(k % 5 != 0, F.col("p_size")).alias("page_count"), F.when(k % 7 != 0, k * 1_000_000_000).otherwise(0).alias("mtime_ns"), F.when(k % 2 != 0, F.col("p_size")).alias("width"), k.alias("height"),
    )
    out = iv.member_cells(members)
    return out.select("archive_id", "name", "specs", "resolution", "pages", F.when(F.col("mtime") == "-", "-").otherwise("at").alias("mtime"))


@query("""WITH p AS (SELECT DISTINCT p_size AS n FROM part) SELECT n, sha256(n || '|FULL_COLOR|[' || n || ', ' || (n + 1) || ']|v2') AS set_key,
sha256('a/b' || n || '.jpg' || chr(0) || n || chr(0) || '' || chr(0) || 'ab' || chr(0) || 'IMAGE' || chr(0) || 'c.txt' || chr(0) || '' || chr(0) || '7' || chr(0) || '' || chr(0) || 'OTHER') AS signature FROM p""")
def s10_f19_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    sizes = bi.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    none = F.lit(None).cast("long")
    member = lambda pos, path, size, packed, crc, kind: F.struct(F.lit(pos).alias("pos"), path.alias("path"), size.alias("size"), packed.alias("packed"), crc.alias("crc"), F.lit(kind).alias("kind"))
    two = F.array(member(1, F.lit("c.txt"), none, F.lit(7).cast("long"), F.lit(None).cast("string"), "OTHER"), member(0, F.concat(F.lit("a/b"), n.cast("string"), F.lit(".jpg")), n, none, F.lit("AB"), "IMAGE"))
    return sizes.select("n", fp.set_key(n, F.lit("FULL_COLOR"), F.array(n + 1, n)).alias("set_key"), fp.listing_signature(two).alias("signature"))


# ---- paths, numbers and records -----------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, ['C:\\A//', '/a/b/', 'x\\Y\\', '/'][CAST(p_partkey % 4 AS INTEGER) + 1] || p_name || ['', '/', '\\', '.ZIP'][CAST(p_partkey % 4 AS INTEGER) + 1] AS path FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '(.)/$', '\\1')) AS key, lower(replace(path, '\\', '/')) AS member, path = '/a/b' OR starts_with(path, '/a/b/') AS inside FROM p""")
def p01_p03_path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(pick("C:\\A//", "/a/b/", "x\\Y\\", "/"), "p_name", pick("", "/", "\\", ".ZIP"))
    return bi.table(spark, sf_dir, "part").select("p_partkey", tx.path_key(path).alias("key"), tx.entry_key(path).alias("member"), tx.is_within(path, F.lit("/a/b/")).alias("inside"))


@query(_sql("""SELECT archive_id, CASE WHEN file_size % 7 = 0 THEN 100.0 WHEN file_size % 7 = 6 THEN -1.0 ELSE round(least(100.0, 100.0 * (archive_id % 9) / (file_size % 7)), 6) END AS percent,
CASE WHEN archive_id % 9 >= 2 THEN round(5.0 * (20 - archive_id % 9) / (archive_id % 9), 6) ELSE -1.0 END AS remaining, CASE WHEN archive_id % 5 = 0 THEN '' ELSE CAST(CAST(epoch_ms((mtime_ns // 1000000)::BIGINT) AS DATE) AS VARCHAR) END AS day FROM c"""))
def p12_p16_p17_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, done = _containers(spark, sf_dir), F.col("archive_id") % 9
    total = F.when(F.col("file_size") % 7 != 6, F.col("file_size") % 7)
    # the day is worked out from a time at noon, which every zone up to eleven hours off has in common
    noon = F.floor(F.col("mtime_ns") / 86_400_000_000_000) * 86_400_000_000_000 + 43_200_000_000_000
    day = tx.mtime_day(F.when(F.col("archive_id") % 5 != 0, noon))
    return containers.select(
        "archive_id", F.coalesce(F.round(tx.percent(done, total), 6), F.lit(-1.0)).alias("percent"), F.coalesce(F.round(tx.remaining_seconds(F.lit(5.0), done, F.lit(20)), 6), F.lit(-1.0)).alias("remaining"), F.coalesce(day.cast("string"), F.lit("")).alias("day")
    )


@query(_sql("""SELECT archive_id AS item, CASE WHEN ok THEN t ELSE s END AS state, ok AS moved FROM (SELECT archive_id, s, t, s = 'PENDING' AND t <> 'PENDING' AS ok FROM (
SELECT archive_id, ['PENDING', 'DELETED', 'FAILED'][CAST(archive_id % 3 AS INTEGER) + 1] AS s, ['DELETED', 'FAILED', 'PENDING', 'FAILED'][CAST(archive_id % 4 AS INTEGER) + 1] AS t FROM c))"""))
def d06_deletion_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("archive_id") % len(values) + 1).cast("int"))
    rows = _containers(spark, sf_dir).select(F.col("archive_id").alias("item"), pick("PENDING", "DELETED", "FAILED").alias("state"), F.lit("PENDING").alias("from_state"), pick("DELETED", "FAILED", "PENDING", "FAILED").alias("to_state"))
    return rv.step(rows.select("item", "state"), rows.select("item", "from_state", "to_state"), rv.DELETION_STEPS)


_SETS = """
sets AS (SELECT component, component || ':' || archive_id % 4 AS set_key, archive_id, archive_id % 4 AS computed_at FROM c),
gen AS (SELECT DISTINCT component, component || ':1' AS set_key FROM c WHERE component % 2 = 0),
"""


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.col("component").cast("string"), F.lit(":"), (F.col("archive_id") % 4).cast("string"))
    sets = _containers(spark, sf_dir).select("component", key.alias("set_key"), "archive_id", (F.col("archive_id") % 4).alias("computed_at"))
    named = sets.select("component").distinct().where("component % 2 = 0").select("component", F.array(F.concat(F.col("component").cast("string"), F.lit(":1"))).alias("set_keys"))
    return sets, named


@query(_sql("," + _SETS.rstrip().rstrip(",") + """
SELECT component, set_key, archive_id FROM sets WHERE (component, set_key) IN (SELECT (component, set_key) FROM gen)
UNION ALL SELECT component, set_key, archive_id FROM sets s WHERE component % 2 = 1 AND computed_at = (SELECT max(computed_at) FROM sets t WHERE t.component = s.component)"""))
def d09_current_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.current_sets(*_sets(spark, sf_dir)).select("component", "set_key", "archive_id")


@query(_sql("," + _SETS.rstrip().rstrip(",") + """
SELECT DISTINCT CASE WHEN component % 3 = 0 THEN -1 - component ELSE component END AS component, set_key AS entry FROM sets UNION ALL SELECT DISTINCT component, CAST(component AS VARCHAR) FROM sets WHERE component % 3 = 0"""))
def d10_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, _ = _sets(spark, sf_dir)
    g = F.col("component")
    return rv.review_list(sets.select("component").distinct(), sets.withColumn("component", F.when(g % 3 != 0, g).otherwise(-1 - g)))


@query(_sql("SELECT archive_id, 1 AS version FROM c WHERE archive_id % 4 NOT IN (2, 3) AND archive_id % 5 <> 0 AND archive_id % 3 = 0"))
def d14_unresolved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, i = _containers(spark, sf_dir), F.col("archive_id")
    old = containers.select("archive_id", "file_size", "mtime_ns", F.lit(1).alias("version"), F.when(i % 3 == 0, "UNKNOWN").otherwise("KOREAN").alias("language"), F.lit("SUCCEEDED").alias("state"), F.when(i % 5 == 0, "OCR_UNAVAILABLE").alias("error"))
    new = old.withColumns({"version": F.lit(2), "archive_id": F.when(i % 4 >= 2, i).otherwise(-1 - i)})
    return rv.unresolved_profiles(old.unionByName(new), 2).select("archive_id", "version")


@query("SELECT l_partkey AS archive_id, CAST(min(l_orderkey) AS VARCHAR) AS set_key FROM lineitem GROUP BY 1")
def d07_first_set_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = bi.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("archive_id"), F.col("l_orderkey").alias("set_key"))
    return rv.first_set_wins(targets).withColumn("set_key", F.col("set_key").cast("string"))


@query("""WITH o AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'FULL' ELSE 'PROBE' END AS c, p_name AS p, CASE WHEN p_size % 3 > 0 THEN p_type END AS d FROM part),
n AS (SELECT p_partkey + 5 AS k, CASE WHEN p_size % 5 = 0 THEN 'FULL' ELSE 'PROBE' END AS c, CASE WHEN p_size % 4 > 0 THEN p_brand END AS p, CASE WHEN p_size % 7 > 0 THEN p_brand END AS d FROM part)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN coalesce(o.c, '') = 'FULL' OR coalesce(n.c, '') = 'FULL' THEN 'FULL' ELSE 'PROBE' END AS coverage, coalesce(n.p, o.p, '') AS pixel, coalesce(n.d, o.d, '') AS dhash FROM o FULL JOIN n ON o.k = n.k""")
def k08_z06_merged_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, s = bi.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    old = p.select(k.alias("k"), F.when(s % 2 == 0, "FULL").otherwise("PROBE").alias("coverage"), F.col("p_name").alias("pixel"), F.when(s % 3 > 0, F.col("p_type")).alias("dhash"))
    new = p.select((k + 5).alias("k"), F.when(s % 5 == 0, "FULL").otherwise("PROBE").alias("coverage"), F.when(s % 4 > 0, F.col("p_brand")).alias("pixel"), F.when(s % 7 > 0, F.col("p_brand")).alias("dhash"))
    out = rv.merge_fingerprints(old, new, ["k"])
    return out.select("k", "coverage", F.coalesce("pixel", F.lit("")).alias("pixel"), F.coalesce("dhash", F.lit("")).alias("dhash"))


@query(_sql("SELECT archive_id FROM c WHERE archive_id % 6 = 1"))
def k09_stale_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = _containers(spark, sf_dir)
    facts = containers.withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("archive_id") % 6 == 1, 1).otherwise(0))
    return rv.stale(facts, containers).select("archive_id")


@query("""WITH g AS (SELECT p_partkey AS component, p_brand AS label, p_size / 50.0 AS confidence, p_size AS members, p_size % 2 = 0 AS needs_review FROM part)
SELECT component, CAST(row_number() OVER (ORDER BY lower(label), confidence DESC, component) AS INTEGER) AS by_name, CAST(row_number() OVER (ORDER BY confidence DESC, lower(label), component) AS INTEGER) AS by_confidence,
       CAST(row_number() OVER (ORDER BY members DESC, lower(label), component) AS INTEGER) AS by_files, CAST(row_number() OVER (ORDER BY needs_review DESC, lower(label), component) AS INTEGER) AS by_status FROM g""")
def v05_group_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bi.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("component"), F.col("p_brand").alias("label"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_size").alias("members"), (F.col("p_size") % 2 == 0).alias("needs_review"))
    out = g.select("component")
    for mode in ("name", "confidence", "files", "status"):
        places = tb.ranked(g, tb.group_order(mode), f"by-{mode}").select("component", (F.col("place") + 1).cast("int").alias(f"by_{mode}"))
        out = out.join(places, "component")
    return out


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + 1 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey + 1),
n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT a, b, (a % 3) * 0.4 AS ca, (b % 3) * 0.4 AS cb, a % 4 = 0 AND b % 4 = 1 AS translated, CASE a % 3 WHEN 0 THEN 'EXACT_CONTENT' WHEN 1 THEN 'RELATED' ELSE 'VISUAL_VARIANT' END AS relation, n FROM e JOIN n ON k = a),
f AS (SELECT *, (ca <= 0.15 AND cb >= 0.5) OR (cb <= 0.15 AND ca >= 0.5) AS color FROM x)
SELECT a, b, array_to_string(list_filter([CASE WHEN color THEN 'COLOR_MONO' END, CASE WHEN translated THEN 'TRANSLATION' END, CASE WHEN NOT color AND NOT translated AND relation <> 'EXACT_CONTENT' AND n >= 3 THEN 'EDIT_OR_CENSORSHIP' END, CASE WHEN a % 5 = 0 THEN 'QUALITY' END], lambda t: t IS NOT NULL), ',') AS flags,
       color OR translated OR (relation <> 'EXACT_CONTENT' AND n >= 3) AS preserve FROM f""")
def m10_edition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliomatch.operators import editions as ed

    n = _units(spark, sf_dir).groupBy("archive_id").agg(F.count("*").alias("matched"))
    ids = bi.table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("a"))
    a = F.col("a")
    relation = F.when(a % 3 == 0, "EXACT_CONTENT").when(a % 3 == 1, "RELATED").otherwise("VISUAL_VARIANT")
    reasons = F.when(a % 5 == 0, F.array(F.lit("LEFT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER"))).otherwise(F.array().cast("array<string>"))
    edges = n.withColumnRenamed("archive_id", "a").join(ids, "a").select("a", (a + 1).alias("b"), relation.alias("relation"), "matched", reasons.alias("reasons"))
    every = edges.select("a").union(edges.select("b")).distinct().toDF("archive_id")
    i = F.col("archive_id")
    hints = every.select("archive_id", F.when(i % 4 == 0, F.array(F.lit("ko"))).when(i % 4 == 1, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("hints"))
    out = ed.compare_editions(edges, every.select("archive_id", ((i % 3) * 0.4).alias("color_page_ratio")), hints)
    return out.select("a", "b", F.array_join("flags", ",").alias("flags"), "preserve")
