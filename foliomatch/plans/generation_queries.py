"""Registered queries over documents in two generations of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.operators import inventory as iv
from foliomatch.plans.runs import Run, input_fingerprint
from foliomatch.plans.stages import materialize, new_path, spread
from foliomatch.sources import archives as ar
from foliomatch.sources import bindings as bi
from foliomatch.sources.generations import Generations, replace_relations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(bi.table(spark, sf_dir, "documents"), "doc_id")
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    line = F.lower(F.trim("line"))
    return lines.select("doc_id", F.sha2(line, 256).alias("h"), F.length(line).alias("n")).distinct()


def shared_line_relations(lines: DataFrame, least: int, most: int) -> DataFrame:
    """``(a, b)``: documents and the first one with which they share a line of ``least`` characters that ``most`` or fewer hold."""
    long = lines.where(F.col("n") >= least)
    firsts = long.groupBy("h").agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).where(F.col("k").between(2, most))
    return long.join(firsts, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


_LINES = r"""
l AS (SELECT DISTINCT doc_id, sha256(lower(trim(x))) AS h, length(trim(x)) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)),
f AS (SELECT h, min(doc_id) AS a FROM l WHERE n >= 60 GROUP BY h HAVING count(*) BETWEEN 2 AND 200),
e AS (SELECT DISTINCT a, doc_id AS b FROM l JOIN f USING (h) WHERE n >= 60 AND doc_id <> a),
"""


@query("WITH RECURSIVE" + _LINES + """
hop AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach AS (SELECT x AS node, x AS near FROM hop UNION SELECT r.node, h.y FROM reach r JOIN hop h ON h.x = r.near)
SELECT node AS archive_id, min(near) AS component FROM reach GROUP BY node""")
def k04_replaced_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph is published by one rule for shared lines and replaced by a stricter one; groups follow from what changed."""
    store = Generations(spark, new_path(spark, "graphs"))
    lines = materialize(_lines(spark, sf_dir), "document-lines")
    usable = F.lit(True)
    replace_relations(store, "root=1", shared_line_relations(lines, 30, 20), usable)
    replace_relations(store, "root=1", shared_line_relations(lines, 60, 200), usable)
    return store.open().table("groups", "root=1").select("archive_id", "component")


def _without_repeats(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def _archives(docs: DataFrame, text: Column) -> DataFrame:
    state = F.when(F.col("source").isNull(), "FAILED").otherwise("INDEXED")
    return docs.select(F.col("doc_id").alias("archive_id"), state.alias("state"), F.octet_length(text).cast("long").alias("file_size"), F.col("n_chars").cast("long").alias("mtime_ns"))


def _images(docs: DataFrame, text: Column) -> DataFrame:
    at = F.posexplode(F.split(text, "\n")).alias("pos", "line")
    lines = docs.select(F.col("doc_id").alias("archive_id"), F.when(F.col("lang") == "de", 1).otherwise(2).alias("version"), at)
    blank = F.trim("line") == ""
    return lines.select("archive_id", "version", "pos", F.when(blank, "FAILED").otherwise("SUCCEEDED").alias("state"), F.when(~blank, F.sha2("line", 256)).alias("pixel"))


def two_generations(spark: SparkSession, sf_dir: str) -> Generations:
    """Documents as containers of lines: as they are, and after repeated lines went, each with the fingerprints of its time."""
    docs = spread(bi.table(spark, sf_dir, "documents"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    store = Generations(spark, new_path(spark, "inventory"))
    for text in (F.col("text"), _without_repeats(F.col("text"))):
        archives = _archives(docs, text)
        version = F.when(F.col("lang") == "de", 1).otherwise(2)
        sha = docs.select(F.col("doc_id").alias("archive_id"), version.alias("version"), F.sha2(text, 256).alias("sha256"))
        prints = sha.join(archives.drop("state"), "archive_id")
        store.commit({"archives": archives, "fingerprints": prints, "images": _images(docs, text)})
    return store


_TWO = r"""
d AS (SELECT doc_id, lang, source, n_chars, g, CASE WHEN g = 1 THEN t ELSE list_filter(t, lambda x, i: list_position(t, x) = i) END AS parts
      FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), (SELECT unnest([1, 2]) AS g)),
a AS (SELECT doc_id AS archive_id, lang, g, CASE WHEN source IS NULL THEN 'FAILED' ELSE 'INDEXED' END AS state,
             CAST(strlen(array_to_string(parts, chr(10))) AS BIGINT) AS file_size, CAST(n_chars AS BIGINT) AS mtime_ns, parts FROM d),
"""


@query("WITH" + _TWO.rstrip().rstrip(",") + """
SELECT g AS generation, state, count(*) AS archives, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(len(parts)) AS BIGINT) AS images,
       CAST(sum(len(list_filter(parts, lambda x: trim(x) <> ''))) AS BIGINT) AS readable
FROM a GROUP BY g, state""")
def s09_snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both generations, each read through a snapshot; that of the first is opened before the second one is written."""
    store = two_generations(spark, sf_dir)
    out = None
    for number in (1, 2):
        state = store.open(number)
        per = state.table("images").groupBy("archive_id").agg(F.count("*").alias("n"), F.count("pixel").alias("ok"))
        rows = state.table("archives").join(per, "archive_id").groupBy("state").agg(
            F.count("*").alias("archives"), F.sum("file_size").alias("bytes"), F.sum("n").alias("images"), F.sum("ok").alias("readable")
        )
        rows = rows.select(F.lit(number).alias("generation"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("WITH" + _TWO + r"""
n AS (SELECT *, len(parts) - 1 AS last FROM a WHERE g = 1 AND lang IS DISTINCT FROM 'de' AND state = 'INDEXED'),
p AS (SELECT archive_id, file_size, mtime_ns, parts, list_distinct([0, CAST(round_even(last * 0.1, 0) AS INTEGER), CAST(round_even(last * 0.25, 0) AS INTEGER),
      CAST(round_even(last * 0.5, 0) AS INTEGER), CAST(round_even(last * 0.75, 0) AS INTEGER), CAST(round_even(last * 0.9, 0) AS INTEGER), CAST(last AS INTEGER)]) AS places FROM n),
s AS (SELECT archive_id, file_size, mtime_ns, unnest(range(len(places))) AS slot, unnest(list_sort(places)) AS pos, parts FROM p)
SELECT s.archive_id, CAST(slot AS INTEGER) AS slot, CAST(pos AS INTEGER) AS pos, sha256(s.parts[pos + 1]) AS pixel
FROM s JOIN a AS now ON now.g = 2 AND now.archive_id = s.archive_id AND now.file_size = s.file_size AND now.mtime_ns = s.mtime_ns AND now.state = 'INDEXED'
WHERE trim(s.parts[pos + 1]) <> ''""")
def s11_candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of the first generation for analyzer version 2, without those of containers that the second one has changed."""
    store = two_generations(spark, sf_dir)
    one = store.open(1)
    found = iv.candidate_evidence(one.table("archives"), one.table("fingerprints"), one.table("images"), version=2)
    return iv.still_current(found, store.open().table("archives")).select("archive_id", "slot", "pos", "pixel")


@query(r"""
WITH d AS (SELECT doc_id, 'c' || lpad(CAST(doc_id // 64 AS VARCHAR), 10, '0') AS container, coalesce(text, '') AS text FROM documents)
SELECT container, CAST(row_number() OVER (PARTITION BY container ORDER BY doc_id) - 1 AS INTEGER) AS pos, doc_id || '.txt' AS member,
       CAST(strlen(text) AS BIGINT) AS size, 'OTHER' AS kind, sha256(text) AS sha256 FROM d""")
def s03_s06_container_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as ZIP containers of 64, which are found, listed and read again by ranges, each member by its place."""
    docs = spread(bi.table(spark, sf_dir, "documents"), "doc_id")
    name = F.concat(F.lit("c"), F.lpad(F.floor(F.col("doc_id") / 64).cast("string"), 10, "0"))
    member = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    root = new_path(spark, "containers")
    materialize(ar.write_containers(docs.select(name.alias("container"), member.alias("member"), F.col("text").cast("binary").alias("payload")), root), "written")
    files = materialize(ar.discover(spark, root).select("path", "file_size", "mtime_ns"), "found")
    members = materialize(ar.list_members(files), "members")
    read = ar.read_members(files, members).where("error IS NULL").select("path", "member", F.sha2("payload", 256).alias("sha256"))
    rows = members.join(read, ["path", "member"])
    return rows.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("container"), "pos", "member", "size", "kind", "sha256")


@query(r"""
WITH d AS (SELECT 'c' || lpad(CAST(doc_id // 64 AS VARCHAR), 10, '0') AS container, count(*) AS members FROM documents GROUP BY 1)
SELECT container, members, true AS same FROM d""")
def f11_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of container files in chunks, each against that of the whole file as one value."""
    docs = spread(bi.table(spark, sf_dir, "documents"), "doc_id")
    name = F.concat(F.lit("c"), F.lpad(F.floor(F.col("doc_id") / 64).cast("string"), 10, "0"))
    root = new_path(spark, "digests")
    rows = docs.select(name.alias("container"), F.col("doc_id").cast("string").alias("member"), F.col("text").cast("binary").alias("payload"))
    written = materialize(ar.write_containers(rows, root), "written")
    digests = ar.file_digests(ar.discover(spark, root).select("path", "file_size", "mtime_ns"))
    whole = spark.read.format("binaryFile").load(root).select("path", F.sha2("content", 256).alias("whole"))
    both = digests.join(whole, "path").select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("container"), F.col("sha256").eqNullSafe(F.col("whole")).alias("same"))
    return written.join(both, "container").select("container", "members", "same")


def _line_run(run: Run, docs: DataFrame, stop: str | None = None) -> DataFrame | None:
    """Lines, how many documents have each, and per document its lines that others have; ends before stage ``stop``."""
    lines = None
    for name in ("lines", "shared", "documents"):
        if name == stop:
            return None
        if name == "lines":
            at = F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")
            lines = run.stage(name, lambda: docs.select("doc_id", at).select("doc_id", F.sha2("line", 256).alias("h")).distinct())
        elif name == "shared":
            shared = run.stage(name, lambda: lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), least=2)
        else:
            out = run.stage(name, lambda: lines.join(shared, "h", "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("n").alias("shared")))
    return out


@query(r"""
WITH l AS (SELECT DISTINCT doc_id, sha256(x) AS h FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)),
s AS (SELECT h, count(*) AS n FROM l GROUP BY h HAVING count(*) > 1)
SELECT doc_id, count(*) AS lines, count(n) AS shared, 1 AS stages_run FROM l LEFT JOIN s USING (h) GROUP BY doc_id""")
def x02_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ended before its last stage, started again: it works out that stage alone."""
    docs = bi.table(spark, sf_dir, "documents")
    root, key = new_path(spark, "runs"), input_fingerprint(docs)
    _line_run(Run(spark, root, key), docs, stop="documents")
    again = Run(spark, root, key)
    out = _line_run(again, docs)
    return out.select("doc_id", "lines", "shared", F.lit(len(again.ran)).alias("stages_run"))


@query(r"""
WITH d AS (SELECT DISTINCT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, doc_id // 64 AS k FROM documents)
SELECT source || '/' || lang || '/c' || lpad(CAST(k AS VARCHAR), 10, '0') || '.zip' AS path, 'zip' AS format, '' AS code, true AS same_size FROM d""")
def s01_discovered_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written into folders by source and language and found again, depth by depth, with the sizes that a scan has."""
    docs = spread(bi.table(spark, sf_dir, "documents"), "doc_id")
    none = F.lit("none")
    name = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.concat(F.lit("c"), F.lpad(F.floor(F.col("doc_id") / 64).cast("string"), 10, "0")))
    root = new_path(spark, "tree")
    rows = docs.select(name.alias("container"), F.col("doc_id").cast("string").alias("member"), F.col("text").cast("binary").alias("payload"))
    materialize(ar.write_containers(rows, root), "written")
    tail = F.regexp_extract("path", r"([^/]*/[^/]*/[^/]*)$", 1)
    found = ar.discover_folders(spark, root).select(tail.alias("path"), "format", F.coalesce("code", F.lit("")).alias("code"), "file_size")
    scanned = ar.discover(spark, root).select(tail.alias("path"), F.col("file_size").alias("_size"))
    return found.join(scanned, "path", "left").select("path", "format", "code", F.col("file_size").eqNullSafe(F.col("_size")).alias("same_size"))
