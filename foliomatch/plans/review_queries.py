"""Registered queries over orders, events and parts: ledgers, snapshots, tables and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.functions.fingerprints import relative_direction
from foliomatch.operators import editions as ed
from foliomatch.operators import inventory as iv
from foliomatch.operators import matching as ma
from foliomatch.operators import recommend as rc
from foliomatch.operators import review as rv
from foliomatch.operators import tables as tb
from foliomatch.plans.stages import materialize
from foliomatch.sources import bindings as bi
from foliomatch.streaming import ledger as sl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# A user of ``events`` stands for a container: its snapshot is (events, last second), its ledger the events themselves.
LEDGER = """
ledger AS (SELECT event_id AS id, user_id AS archive_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'KEEP' WHEN event_type = 'click' THEN 'REMOVE_CANDIDATE' ELSE 'HOLD' END AS action,
                  CAST(event_id % 3 AS BIGINT) AS file_size, CAST(user_id % 5 AS BIGINT) AS mtime_ns FROM events),
containers AS (SELECT DISTINCT archive_id, CAST(archive_id % 3 AS BIGINT) AS file_size, CAST(archive_id % 5 AS BIGINT) AS mtime_ns FROM ledger),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY id DESC) AS nth FROM ledger) WHERE nth = 1),
state AS (SELECT c.archive_id, l.action, l.action IS NOT NULL AND (l.file_size <> c.file_size OR l.mtime_ns <> c.mtime_ns) AS needs_review, c.file_size FROM containers c LEFT JOIN last l USING (archive_id)),
"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bi.ledger_actions(spark, sf_dir).select("id", "archive_id", "action", (F.col("id") % 3).alias("file_size"), (F.col("archive_id") % 5).alias("mtime_ns"))
    ids = rows.select("archive_id").distinct()
    return rows, ids.select("archive_id", (F.col("archive_id") % 3).alias("file_size"), (F.col("archive_id") % 5).alias("mtime_ns"))


def _only(rows: DataFrame, test) -> DataFrame:
    """All rows, those that fail ``test`` under an id that no container has: as records of others, whom nothing here meets."""
    return rows.withColumn("archive_id", F.when(test, F.col("archive_id")).otherwise(-1 - F.col("archive_id")))


def _sql(last: str) -> str:
    return "WITH " + LEDGER.rstrip().rstrip(",") + "\n" + last


@query(_sql("SELECT archive_id, id, action FROM last"))
def v01_latest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.latest_by_window(_ledger(spark, sf_dir)[0]).select("archive_id", "id", "action")


@query(_sql("SELECT archive_id, id, action FROM last"))
def c14_latest_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.latest(_ledger(spark, sf_dir)[0]).select("archive_id", "id", "action")


@query(_sql("SELECT archive_id, action, needs_review FROM state"))
def d02_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.review_state(*_ledger(spark, sf_dir))


@query(_sql("SELECT archive_id % 40 AS component, count(*) AS members, bool_or(action IS NOT NULL) AND NOT bool_and(action IS NOT NULL AND NOT needs_review) AS needs_review FROM state GROUP BY 1"))
def a02_group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    members = containers.select((F.col("archive_id") % 40).alias("component"), "archive_id")
    return rv.group_summaries(members, rv.review_state(rows, containers))


_BUCKETS = "CASE WHEN archive_id % 11 = 0 THEN 'DELETED' WHEN needs_review THEN 'NEEDS_REVIEW' WHEN action = 'KEEP' THEN 'KEEP' WHEN action = 'HOLD' THEN 'HOLD' WHEN action = 'REMOVE_CANDIDATE' AND archive_id % 7 = 0 THEN 'QUARANTINED' WHEN action = 'REMOVE_CANDIDATE' THEN 'REMOVE' ELSE 'UNREVIEWED' END"


@query(_sql(f"SELECT {_BUCKETS} AS bucket, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM state GROUP BY 1"))
def a13_action_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    members = rv.review_state(rows, containers).join(containers.select("archive_id", "file_size"), "archive_id")
    return rv.preview_actions(members.withColumns({"deleted": F.col("archive_id") % 11 == 0, "quarantined": F.col("archive_id") % 7 == 0}))


@query(_sql("SELECT CAST(archive_id % 40 AS BIGINT) AS component, CASE WHEN bool_or(archive_id % 97 = 0) THEN 4 WHEN bool_or(archive_id % 13 = 0) THEN 2 WHEN bool_and(archive_id % 11 = 0) THEN 3 WHEN bool_and(action <> 'HOLD') THEN 1 ELSE 0 END AS tab FROM state GROUP BY 1"))
def v11_group_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    i = F.col("archive_id")
    members = rv.review_state(rows, containers).select((i % 40).alias("component"), (i % 97 == 0).alias("problem"), (i % 11 == 0).alias("deleted"), (i % 13 == 0).alias("quarantined"), (F.col("action") != "HOLD").alias("reviewed"))
    return rv.group_tabs(members)


@query(_sql("""SELECT CAST(c.archive_id % 40 AS VARCHAR) AS set_key, c.archive_id, CASE WHEN c.archive_id % 4 = 0 THEN 'NO_RECOMMENDATION' WHEN c.archive_id % 6 = 1 THEN 'CHANGED_SNAPSHOT_SKIPPED' WHEN c.archive_id % 10 = 3 THEN 'ALREADY_APPLIED' WHEN l.action IS NOT NULL THEN 'USER_DECISION_SKIPPED' ELSE 'APPLIED' END AS outcome
FROM containers c LEFT JOIN (SELECT * FROM last WHERE archive_id % 2 = 0) l USING (archive_id)"""))
def d03_apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    i = F.col("archive_id")
    items = containers.select((i % 40).cast("string").alias("set_key"), "archive_id", F.when(i % 4 == 0, "NONE").otherwise("KEEP").alias("recommendation"), (F.col("file_size") + F.when(i % 6 == 1, 1).otherwise(0)).alias("file_size"), "mtime_ns")
    return rv.apply_recommendations(items, containers, _only(rows, i % 2 == 0), _only(items, i % 10 == 3))


# Events as requests: what each type asks for. A user's first event in time is the state that its item is in.
_REQUESTS = {"view": ("PENDING", "QUARANTINED"), "click": ("QUARANTINED", "RESTORING"), "error": ("RESTORING", "FAILED"), "purchase": ("PENDING", "DELETED"), "signup": ("RESTORING", "RESTORED")}


@query("""WITH e AS (SELECT user_id AS item, event_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'QUARANTINED' WHEN 'purchase' THEN 'PENDING' ELSE 'RESTORING' END AS f,
CASE event_type WHEN 'view' THEN 'QUARANTINED' WHEN 'click' THEN 'RESTORING' WHEN 'purchase' THEN 'DELETED' WHEN 'signup' THEN 'RESTORED' ELSE 'FAILED' END AS t FROM events),
r AS (SELECT item, arg_min(f, event_id) AS state, min(event_id) AS first FROM e GROUP BY item),
w AS (SELECT r.item, min(t) AS t FROM e JOIN r ON r.item = e.item AND e.event_id > r.first AND e.f = r.state WHERE t <> 'DELETED' GROUP BY r.item)
SELECT item, coalesce(t, state) AS state, t IS NOT NULL AS moved FROM r LEFT JOIN w USING (item)""")
def d05_quarantine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item with all requests of its user at once: only those from the state that it is in are looked at."""
    e = bi.table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", "event_type")
    states = F.create_map(*[F.lit(x) for k, (a, b) in _REQUESTS.items() for x in (k, f"{a}|{b}")])
    asked = F.split(states[F.col("event_type")], r"\|")
    rows = e.select("item", "event_id", asked[0].alias("from_state"), asked[1].alias("to_state"))
    records = rows.groupBy("item").agg(F.min_by("from_state", "event_id").alias("state"), F.min("event_id").alias("first"))
    later = rows.join(records.select("item", "first"), "item").where("event_id > first")
    return rv.step(records.select("item", "state"), later, rv.QUARANTINE_STEPS)


@query("""WITH q AS (SELECT event_id AS id, user_id AS archive_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'QUARANTINED' WHEN 'signup' THEN 'RESTORING' ELSE 'RESTORED' END AS state FROM events),
d AS (SELECT event_id - 1 AS quarantine_id FROM events WHERE event_type = 'purchase' AND value < 20),
l AS (SELECT archive_id, max(id) AS id FROM q WHERE state <> 'RESTORED' GROUP BY archive_id)
SELECT q.id, q.archive_id, q.state FROM q JOIN l ON l.id = q.id WHERE q.id NOT IN (SELECT quarantine_id FROM d)""")
def d13_active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quarantine records; a purchase deletes, or fails to delete, what the event before it is a record of."""
    e = bi.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    state = F.when(kind == "view", "PENDING").when(kind == "click", "QUARANTINED").when(kind == "signup", "RESTORING").otherwise("RESTORED")
    records = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("archive_id"), state.alias("state"))
    bought = e.where(kind == "purchase").select((F.col("event_id") - 1).alias("quarantine_id"), F.when(F.col("value") < 20, "DELETED").otherwise("FAILED").alias("state"))
    return rv.active_items(records, bought).select("id", "archive_id", "state")


@query(_sql("SELECT archive_id, CASE WHEN action <> 'REMOVE_CANDIDATE' THEN 'NOT_REMOVE_CANDIDATE' WHEN needs_review THEN 'SNAPSHOT_CHANGED' WHEN archive_id % 5 = 0 THEN 'ALREADY_QUARANTINED' ELSE 'OK' END AS code FROM state"))
def d11_quarantine_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    return rv.quarantine_codes(containers, rows, containers, _only(containers, F.col("archive_id") % 5 == 0))


@query(_sql("SELECT archive_id, CASE WHEN archive_id % 3 = 0 THEN 'NOT_QUARANTINED' WHEN archive_id % 4 = 0 THEN 'NO_HASH' WHEN action <> 'REMOVE_CANDIDATE' THEN 'NOT_REMOVE_CANDIDATE' WHEN needs_review THEN 'SNAPSHOT_CHANGED' ELSE 'OK' END AS code FROM state"))
def d12_deletion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    i = F.col("archive_id")
    active = containers.select("archive_id", F.when(i % 3 == 0, "PENDING").otherwise("QUARANTINED").alias("state"), F.when(i % 4 == 0, "").otherwise("h").alias("sha256"))
    return rv.deletion_codes(active, rows, containers)


@query(_sql("SELECT c.archive_id FROM containers c WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.archive_id = c.archive_id AND l.file_size = c.file_size AND l.mtime_ns = c.mtime_ns)"))
def w05_without_current_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers whose last fact is of another snapshot: a fact replaces the one before."""
    rows, containers = _ledger(spark, sf_dir)
    return rv.without_fact(containers, rv.latest(rows)).select("archive_id")


@query(_sql("SELECT id FROM ledger l JOIN containers c USING (archive_id, file_size, mtime_ns)"))
def w04_current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    return rv.current(rows, containers).select("id")


@query(_sql("SELECT archive_id, file_size, max(id) AS version FROM ledger GROUP BY ALL"))
def c13_newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _ledger(spark, sf_dir)
    return rv.newest_version(rows.withColumnRenamed("id", "version"), "archive_id", "file_size").select("archive_id", "file_size", "version")


@query(_sql("SELECT archive_id, 'KEEP' AS action FROM state WHERE (action IS NULL OR needs_review) AND archive_id % 11 <> 0 AND archive_id % 13 NOT IN (0, 1)"))
def d04_keep_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, containers = _ledger(spark, sf_dir)
    i = F.col("archive_id")
    quarantine = F.when(i % 13 == 0, "PENDING").when(i % 13 == 1, "FAILED").when(i % 13 == 2, "RESTORED")
    members = containers.select((i % 40).alias("component"), "archive_id", (i % 11 == 0).alias("deleted"), quarantine.alias("quarantine"))
    return rv.keep_unreviewed(members, rv.review_state(rows, containers))


@query("SELECT user_id AS archive_id, max(ts) FILTER (WHERE event_type = 'click') AS click_at, max(ts) FILTER (WHERE event_type = 'purchase') AS purchase_at FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def a12_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bi.table(spark, sf_dir, "events").select(F.col("user_id").alias("archive_id"), F.col("ts").alias("at"), "event_type")
    return rv.activity(*[(k, e.where(F.col("event_type") == k)) for k in ("click", "purchase")])


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS n FROM part QUALIFY n > 1")
def w01_size_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.size_collisions(bi.table(spark, sf_dir, "part"), "p_size").select("p_partkey", "n")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE contains(lower(p_name), 'a') AND p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def w08_table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [{"column": "p_name", "contains": "A"}, {"column": "p_size", "least": 5, "most": 30}, {"column": "p_brand", "any_of": ["Brand#11", "Brand#12", "Brand#13"]}]
    return tb.apply_view(bi.table(spark, sf_dir, "part"), filters, [("p_retailprice", True)], "p_partkey").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def w10_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.facet(bi.table(spark, sf_dir, "part"), "p_type")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def v06_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.page(bi.table(spark, sf_dir, "customer"), [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 100, 50).select("c_custkey", "c_acctbal")


_TABS = """
g AS (SELECT o_custkey AS component, count(*) AS members, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN 4
      WHEN bool_or(o_orderpriority = '5-LOW' AND o_orderstatus = 'O') THEN 2 WHEN bool_and(o_orderstatus = 'F') THEN 3
      WHEN bool_and(o_orderpriority < '3') THEN 1 ELSE 0 END AS tab FROM orders GROUP BY 1),
"""


@query("WITH" + _TABS + """
r AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY members DESC, component) - 1 AS place, count(*) OVER (PARTITION BY tab) AS n FROM g)
SELECT CAST(tab AS INTEGER) AS tab, component, members, place, place // 20 AS page FROM r WHERE place // 20 IN (0, (n - 1) // 20)""")
def v11_tab_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last page, of 20 groups, of every tab."""
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    members = bi.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("component"), ((status == "P") & (urgency == "1-URGENT")).alias("problem"), (status == "F").alias("deleted"),
        ((urgency == "5-LOW") & (status == "O")).alias("quarantined"), (urgency < "3").alias("reviewed"),
    )
    n = members.groupBy("component").agg(F.count("*").alias("members"))
    index = tb.ranked_tabs(rv.group_tabs(members).join(n, "component"), [F.desc("members"), F.col("component")])
    number = F.floor(F.col("place") / 20)
    return index.where((number == 0) | (number == F.floor((F.col("pages_end") - 1) / 20))).select("tab", "component", "members", "place", number.alias("page"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def s08_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.after_key(bi.table(spark, sf_dir, "orders"), "o_orderkey", 500, 200).select("o_orderkey", "o_custkey")


@query("SELECT lower(o_orderstatus) AS state, count(*) AS n FROM orders GROUP BY 1")
def a18_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.state_counts(bi.table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE nth = (n - 1) // 2 + 1")
def a03_representative_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.lower_median_row(bi.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH k AS (SELECT p_name || CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE '' END || p_partkey AS path, p_size AS s, p_partkey AS m FROM part),
n AS (SELECT p_name || CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE '' END || p_partkey AS path, p_size + (p_partkey % 5 = 0)::INT AS s, p_partkey AS m FROM part)
SELECT coalesce(k.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'MISSING' WHEN k.path IS NULL THEN 'NEW' WHEN k.s = n.s AND k.m = n.m THEN 'REUSED' ELSE 'CHANGED' END AS outcome FROM k FULL JOIN n ON n.path = k.path""")
def x01_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = bi.table(spark, sf_dir, "part"), F.col("p_partkey")

    def named(mark: str, every: int, size) -> DataFrame:
        return p.select(F.concat("p_name", F.when(k % every == 0, mark).otherwise(""), k.cast("string")).alias("path"), size.alias("file_size"), k.alias("mtime_ns"))

    return sl.rescan(named("old", 7, F.col("p_size")), named("new", 6, F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0)))


@query("""WITH o AS (SELECT p_partkey AS k, p_size AS v FROM part), n AS (SELECT p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1000000000 ELSE 0 END AS k, (p_partkey % 50)::INT AS v FROM part)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.v > o.v THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.k = n.k""")
def k03_merge_if_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = bi.table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.select(k.alias("k"), F.col("p_size").alias("v"))
    new = p.select((k + F.when(k % 3 == 0, 1_000_000_000).otherwise(0)).alias("k"), (k % 50).cast("int").alias("v"))
    return rv.merge_rows(old, new, ["k"], F.col("n.v") > F.col("o.v"))


# ---- orders as members of sets ------------------------------------------------------------------------------------

INPUTS = """
items AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1),
inputs AS (
  SELECT o_custkey AS set_key, o_orderkey AS archive_id, CAST(o_totalprice AS BIGINT) AS file_size, n AS page_count, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS mtime_ns, q AS resolution_area,
         CAST(o_orderkey % 3 + 1 AS INTEGER) AS title_rank, CASE o_orderkey % 4 WHEN 0 THEN 'JAPANESE' ELSE 'KOREAN' END AS language,
         CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 5 = 1 THEN NULL ELSE 1 END AS mosaic_rank, CAST(o_orderkey % 2 + 1 AS INTEGER) AS color_rank, CASE WHEN o_custkey % 10 = 0 THEN 'filename' ELSE 'precision' END AS language_source
  FROM orders JOIN items ON l_orderkey = o_orderkey),
ev AS (SELECT l.archive_id AS a, r.archive_id AS b, l.set_key % 9 = 0 AS eq FROM inputs l JOIN inputs r ON l.set_key = r.set_key AND l.archive_id < r.archive_id WHERE (l.archive_id + r.archive_id) % 11 <> 0),
cmp AS (
  SELECT l.set_key, l.archive_id AS a, r.archive_id AS b, ev.a IS NOT NULL AS has_evidence, coalesce(ev.eq, false) AS equivalent,
         NOT (coalesce(ev.eq, false) AND starts_with(l.language_source, 'precision') AND starts_with(r.language_source, 'precision')) AND NOT (l.language_source = 'precision' AND r.language_source = 'precision') AS review,
         {resolution} AS resolution, {size} AS size, {pages} AS pages,
         CASE WHEN abs(l.mtime_ns - r.mtime_ns) <= 2000000000 THEN 'TIE' WHEN l.mtime_ns > r.mtime_ns THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS mtime,
         {title} AS title,
         CASE WHEN coalesce(ev.eq, false) AND starts_with(l.language_source, 'precision') AND starts_with(r.language_source, 'precision') THEN 'TIE' WHEN l.language_source <> 'precision' OR r.language_source <> 'precision' THEN 'UNKNOWN'
              WHEN l.language = r.language THEN 'TIE' WHEN l.language = 'KOREAN' THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS language,
         CASE WHEN l.mosaic_rank IS NULL OR r.mosaic_rank IS NULL OR l.mosaic_rank = r.mosaic_rank THEN 'TIE' WHEN l.mosaic_rank > r.mosaic_rank THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS mosaic,
         'TIE' AS quality, {color} AS color
  FROM inputs l JOIN inputs r ON l.set_key = r.set_key AND l.archive_id < r.archive_id LEFT JOIN ev ON ev.a = l.archive_id AND ev.b = r.archive_id),
"""


def _number(c: str, tie: float) -> str:
    return f"CASE WHEN NOT coalesce(l.{c} > 0 AND r.{c} > 0, false) THEN 'UNKNOWN' WHEN abs(l.{c} - r.{c}) / greatest(l.{c}, r.{c}) <= {tie} THEN 'TIE' WHEN l.{c} > r.{c} THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END"


INPUTS = INPUTS.format(resolution=_number("resolution_area", 0.02), size=_number("file_size", 0.01), pages=_number("page_count", 0), title=_number("title_rank", 0), color=_number("color_rank", 0))
CMP = INPUTS[INPUTS.index("cmp AS (") :]
_FLIP = lambda c: f"CASE {c} WHEN 'LEFT_BETTER' THEN 'RIGHT_BETTER' WHEN 'RIGHT_BETTER' THEN 'LEFT_BETTER' ELSE {c} END AS {c}"
_NAMES = [*rc.CRITERIA, "color"]
_SIDED = f"""
sided AS (
  SELECT set_key, a AS archive_id, b AS other, has_evidence, equivalent, review, {', '.join(_NAMES)} FROM cmp
  UNION ALL SELECT set_key, b, a, has_evidence, equivalent, review, {', '.join(_FLIP(c) for c in _NAMES)} FROM cmp),
"""
SIDED = INPUTS + _SIDED


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = bi.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("page_count"), F.sum("l_quantity").cast("long").alias("resolution_area"))
    k = F.col("o_orderkey")
    rows = bi.table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == k).select(
        F.col("o_custkey").alias("set_key"), k.alias("archive_id"), F.round("o_totalprice").cast("long").alias("file_size"), "page_count", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("mtime_ns"), "resolution_area",
        (k % 3 + 1).cast("int").alias("title_rank"), F.when(k % 4 == 0, "JAPANESE").otherwise("KOREAN").alias("language"), F.when(k % 5 == 0, 3).when(k % 5 == 1, None).otherwise(1).alias("mosaic_rank"),
        (k % 2 + 1).cast("int").alias("color_rank"), F.when(F.col("o_custkey") % 10 == 0, "filename").otherwise("precision").alias("language_source"),
    )
    inputs = materialize(rows, "inputs")
    # evidence as pairs of their own, as a run of comparisons leaves them; some pairs have none
    slim = inputs.select("set_key", "archive_id")
    pairs = slim.toDF("set_key", "l_archive_id").join(slim.toDF("set_key", "r_archive_id"), "set_key").where("l_archive_id < r_archive_id AND (l_archive_id + r_archive_id) % 11 <> 0")
    return inputs, pairs.select(F.col("l_archive_id").alias("a"), F.col("r_archive_id").alias("b"), (F.col("set_key") % 9 == 0).alias("content_equivalent"))


def _on_inputs(prefix: str, last: str) -> str:
    return "WITH " + prefix.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)").rstrip().rstrip(",") + "\n" + last


@query(_on_inputs(INPUTS, f"SELECT set_key, a, b, has_evidence, equivalent, review, {', '.join(_NAMES)} FROM cmp WHERE has_evidence"))
def r05_compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.compare_pairs(*_inputs(spark, sf_dir))


_ROLL = lambda c: f"CASE WHEN bool_or({c} = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_or({c} = 'LEFT_BETTER') AND bool_or({c} = 'RIGHT_BETTER') THEN 'MIXED' WHEN bool_or({c} = 'LEFT_BETTER') THEN 'LEFT_BETTER' WHEN bool_or({c} = 'RIGHT_BETTER') THEN 'RIGHT_BETTER' ELSE 'TIE' END AS {c}"


@query(_on_inputs(SIDED, f"SELECT set_key, archive_id, {', '.join(map(_ROLL, rc.CRITERIA))} FROM sided GROUP BY ALL"))
def r07_rolled_up_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, evidence = _inputs(spark, sf_dir)
    return rc.rolled_up(inputs, rc.evidence_counts(inputs, evidence))


_CORE = [c for c in rc.CRITERIA if c not in rc.TIE_BREAKERS]
_DOMINATES = (
    "(" + " AND ".join(f"{c} IN ('TIE', 'LEFT_BETTER')" for c in _CORE) + " AND CASE WHEN " + " OR ".join(f"{c} = 'LEFT_BETTER'" for c in _CORE)
    + " THEN title IN ('TIE', 'LEFT_BETTER') AND mtime IN ('TIE', 'LEFT_BETTER') WHEN title <> 'TIE' THEN title = 'LEFT_BETTER' ELSE mtime = 'LEFT_BETTER' END)"
)
_RECOMMEND = f"""
, per_set AS (SELECT set_key, bool_or(review) AS review, bool_and(equivalent) AS equal, bool_and(has_evidence) AS evident,
  {', '.join(f"bool_or({c} = 'UNKNOWN') AS u_{c}" for c in rc.CRITERIA)} FROM cmp GROUP BY set_key),
unk AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN u_{c} THEN '{c}' END" for c in rc.CRITERIA)}], lambda x: x IS NOT NULL)) AS unknown FROM per_set),
wins AS (SELECT set_key, archive_id FROM sided GROUP BY ALL HAVING bool_and(has_evidence AND {_DOMINATES})),
dom AS (SELECT set_key, count(*) AS k, min(archive_id) AS winner FROM wins GROUP BY set_key),
titled AS (SELECT *, max(coalesce(title_rank, 0)) OVER (PARTITION BY set_key) AS t FROM inputs),
fresh AS (SELECT *, max(mtime_ns) OVER (PARTITION BY set_key) AS m FROM titled WHERE title_rank = t),
late AS (SELECT set_key, count(*) AS k, min(archive_id) AS latest FROM fresh WHERE mtime_ns = m GROUP BY set_key),
rows AS (SELECT i.set_key, i.archive_id, u.*EXCLUDE (set_key), dom.k AS kd, winner, late.k AS kl, latest FROM inputs i LEFT JOIN unk u USING (set_key) LEFT JOIN dom USING (set_key) LEFT JOIN late USING (set_key))
SELECT set_key, archive_id,
  CASE WHEN review THEN 'ANALYSIS_REQUIRED' WHEN equal IS NULL THEN 'NONE' WHEN equal AND kl = 1 THEN 'RECOMMENDED' WHEN len(unknown) > 0 THEN 'ANALYSIS_REQUIRED' WHEN kd = 1 THEN 'RECOMMENDED' WHEN NOT evident THEN 'ANALYSIS_REQUIRED' ELSE 'NONE' END AS status,
  CASE WHEN review OR equal IS NULL THEN 'NONE' WHEN equal AND kl = 1 THEN CASE WHEN archive_id = latest THEN 'KEEP' ELSE 'REMOVE_CANDIDATE' END WHEN len(unknown) > 0 THEN 'NONE' WHEN kd = 1 THEN CASE WHEN archive_id = winner THEN 'KEEP' ELSE 'REMOVE_CANDIDATE' END ELSE 'NONE' END AS recommendation
FROM rows"""


@query(_on_inputs(SIDED, _RECOMMEND.strip()))
def r08_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.recommend(*_inputs(spark, sf_dir)).select("set_key", "archive_id", "status", "recommendation")


@query(_on_inputs(SIDED, """, o AS (SELECT *, CASE WHEN pages <> 'TIE' THEN pages WHEN color NOT IN ('TIE', 'UNKNOWN') THEN color WHEN size <> 'TIE' THEN size ELSE 'TIE' END AS o FROM sided WHERE has_evidence),
s AS (SELECT set_key, archive_id, count(*) FILTER (WHERE o = 'LEFT_BETTER') AS wins, count(*) AS met, bool_or(o = 'UNKNOWN') AS unresolved FROM o GROUP BY ALL),
m AS (SELECT i.set_key, i.archive_id, count(*) OVER (PARTITION BY i.set_key) AS n, wins, met, unresolved FROM inputs i LEFT JOIN s USING (set_key, archive_id)),
w AS (SELECT set_key, min(archive_id) AS winner FROM m WHERE n > 1 AND wins = n - 1 GROUP BY set_key HAVING count(*) = 1),
u AS (SELECT set_key, bool_or(coalesce(unresolved, false) OR coalesce(met, 0) < n - 1) AS open FROM m GROUP BY set_key)
SELECT m.set_key, m.archive_id, CASE WHEN winner IS NOT NULL THEN 'RECOMMENDED' WHEN open THEN 'ANALYSIS_REQUIRED' ELSE 'NONE' END AS status,
  CASE WHEN winner IS NULL THEN 'NONE' WHEN m.archive_id = winner THEN 'KEEP' ELSE 'REMOVE_CANDIDATE' END AS recommendation FROM m LEFT JOIN w USING (set_key) JOIN u USING (set_key)"""))
def r10_user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.recommend_by_order(*_inputs(spark, sf_dir), ("pages", "color", "size")).drop("last_criteria")


@query("""WITH m AS (SELECT o_custkey AS component, o_orderkey AS archive_id, CASE WHEN o_orderkey % 29 = 0 THEN 'MIXED_OR_UNKNOWN' WHEN o_orderkey % 2 = 0 THEN 'FULL_COLOR' ELSE 'MONOCHROME' END AS kind, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey END AS root FROM orders),
f AS (SELECT *, count(*) OVER w AS n, min(root) OVER w = max(root) OVER w AS one, min(kind) OVER w = max(kind) OVER w AS same, min(kind) OVER w AS k, bool_or(kind = 'MIXED_OR_UNKNOWN') OVER w AS mixed FROM m WINDOW w AS (PARTITION BY component)),
s AS (SELECT component, archive_id, CASE WHEN n >= 2 AND one THEN CASE WHEN same THEN k ELSE 'MIXED_OR_UNKNOWN' END WHEN mixed THEN 'MIXED_OR_UNKNOWN' ELSE kind END AS set_kind FROM f)
SELECT component, set_kind, archive_id FROM s QUALIFY count(*) OVER (PARTITION BY component, set_kind) >= 2""")
def g03_partition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 29 == 0, "MIXED_OR_UNKNOWN").when(k % 2 == 0, "FULL_COLOR").otherwise("MONOCHROME")
    members = bi.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), k.alias("archive_id"), kind.alias("kind"), F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(k).alias("exact_root"))
    return rc.partition_groups(members)


@query("""SELECT o_orderkey, CASE WHEN m = 'UNKNOWN' THEN n WHEN n = 'UNKNOWN' THEN m WHEN m = n THEN m ELSE 'UNKNOWN' END AS language, CASE WHEN r >= 0.5 THEN 'FULL_COLOR' WHEN r <= 0.15 THEN 'MONOCHROME' ELSE 'MIXED_OR_UNKNOWN' END AS color
FROM (SELECT o_orderkey, ['KOREAN', 'JAPANESE', 'UNKNOWN'][o_orderkey % 3 + 1] AS m, ['KOREAN', 'UNKNOWN'][o_orderkey % 2 + 1] AS n, (o_orderkey % 100) / 100.0 AS r FROM orders)""")
def g04_resolved_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return bi.table(spark, sf_dir, "orders").select("o_orderkey", rc.resolve_language(pick(("KOREAN", "JAPANESE", "UNKNOWN")), pick(("KOREAN", "UNKNOWN")), F.lit(False)).alias("language"), rc.resolve_color((k % 100) / 100.0, F.lit(None).cast("string"), F.lit(False)).alias("color"))


@query("""WITH u AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey AS a, r.l_orderkey AS b, CAST(sum(least(l.n, r.n)) AS INTEGER) AS common FROM u l JOIN u r ON r.l_orderkey = l.l_orderkey + 1 AND l.l_partkey = r.l_partkey GROUP BY ALL""")
def c19_order_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = bi.order_parts(spark, sf_dir)
    pairs = units.select(F.col("archive_id").alias("a"), (F.col("archive_id") + 1).alias("b")).distinct()
    return ma.bag_overlap(pairs, units)


@query("""WITH m AS (SELECT l_orderkey AS a, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1),
r AS (SELECT l.a, r.a AS b, l.q AS lq, r.q AS rq, l.d AS ld, r.d AS rd FROM m l JOIN m r ON r.a = l.a + 1)
SELECT a, b, CASE WHEN abs(lq - rq) / greatest(abs(lq), abs(rq), 1e-9) <= 0.03 THEN 'TIE' WHEN lq > rq THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS more,
       CASE WHEN abs(ld - rd) / greatest(abs(ld), abs(rd), 1e-9) <= 0.03 THEN 'TIE' WHEN ld < rd THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS less FROM r""")
def f14_relative_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bi.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    left, right = m.toDF("a", "lq", "ld"), m.select((F.col("l_orderkey") - 1).alias("a"), F.col("l_orderkey").alias("b"), F.col("q").alias("rq"), F.col("d").alias("rd"))
    return left.join(right, "a").select("a", "b", relative_direction(F.col("lq"), F.col("rq")).alias("more"), relative_direction(F.col("ld"), F.col("rd"), True).alias("less"))


def _metric(i: int, low: bool) -> str:
    return (
        f"CASE WHEN abs(l{i} - r{i}) / greatest(abs(l{i}), abs(r{i}), 1e-9) <= 0.03 THEN 'TIE' "
        f"WHEN l{i} {'<' if low else '>'} r{i} THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END"
    )


#: Whether less is better, of each of the six metrics in order.
_LESS_IS_BETTER = (False, True, True, True, False, True)


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey AS a FROM lineitem),
m AS (
  SELECT x.l_orderkey AS a, {', '.join(f"avg(CAST(x.l_quantity AS DOUBLE) + {i}) AS l{i}, avg(CAST(y.l_quantity AS DOUBLE) + {i}) AS r{i}" for i in range(6))}
  FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey + 1 AND y.l_linenumber = x.l_linenumber GROUP BY 1),
d AS (SELECT a, list_filter(list_distinct([{', '.join(_metric(i, low) for i, low in enumerate(_LESS_IS_BETTER))}]), lambda x: x <> 'TIE') AS d FROM m)
SELECT a, a + 1 AS b, CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN len(d) = 0 THEN 'TIE' WHEN len(d) = 1 THEN d[1] ELSE 'UNKNOWN' END AS direction
FROM p LEFT JOIN d USING (a)""")
def m12_quality_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = bi.table(spark, sf_dir, "lineitem")
    metrics = li.select(F.col("l_orderkey").alias("archive_id"), F.col("l_linenumber").alias("pos"), *[(F.col("l_quantity") + i).alias(m) for i, m in enumerate(ed.QUALITY_METRICS)])
    pairs = li.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b")).distinct()
    return ed.compare_quality(pairs, metrics)


@query("WITH RECURSIVE " + _on_inputs(INPUTS[: INPUTS.index("cmp AS (")], """, hop AS (SELECT a AS x, b AS y FROM ev UNION SELECT b, a FROM ev),
reach AS (SELECT x AS node, x AS near FROM hop UNION SELECT r.node, h.y FROM reach r JOIN hop h ON h.x = r.near),
comp AS (SELECT node, min(near) AS comp FROM reach GROUP BY node),
many AS (SELECT set_key FROM inputs GROUP BY 1 HAVING count(*) >= 2),
same AS (SELECT l.set_key FROM inputs l JOIN inputs r ON l.set_key = r.set_key AND l.archive_id < r.archive_id LEFT JOIN ev ON ev.a = l.archive_id AND ev.b = r.archive_id GROUP BY 1 HAVING bool_and(coalesce(ev.eq, false))),
d AS (SELECT i.set_key, i.archive_id, i.page_count, i.mtime_ns // 86400000000000 AS day, comp FROM inputs i LEFT JOIN comp ON node = i.archive_id WHERE i.set_key IN (SELECT set_key FROM many) AND i.set_key NOT IN (SELECT set_key FROM same)),
beaten AS (SELECT x.set_key, x.archive_id, y.archive_id AS by_ FROM d x JOIN d y ON y.set_key = x.set_key AND y.comp = x.comp AND y.day > x.day AND y.page_count > x.page_count),
stay AS (SELECT set_key, archive_id FROM d WHERE archive_id NOT IN (SELECT archive_id FROM beaten)),
gone AS (SELECT DISTINCT archive_id FROM beaten WHERE by_ IN (SELECT archive_id FROM stay)),
rule AS (SELECT d.set_key, count(*) FILTER (WHERE d.archive_id IN (SELECT archive_id FROM stay)) = 1 AND bool_and(d.archive_id IN (SELECT archive_id FROM stay) OR d.archive_id IN (SELECT archive_id FROM gone)) AS done FROM d GROUP BY 1)
SELECT d.set_key, d.archive_id, CASE WHEN NOT done THEN 'NONE' WHEN d.archive_id IN (SELECT archive_id FROM stay) THEN 'KEEP' ELSE 'REMOVE_CANDIDATE' END AS recommendation, CASE WHEN done THEN 'RECOMMENDED' ELSE 'NONE' END AS status FROM d JOIN rule USING (set_key)""").removeprefix("WITH "))
def r03_version_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, evidence = _inputs(spark, sf_dir)
    day = F.to_date(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("long")))
    dated = inputs.withColumns({"series_key": F.lit("order"), "start": day, "end": day, "is_range": F.lit(False), "mtime_day": day})
    return rc.version_rule(dated, evidence)
