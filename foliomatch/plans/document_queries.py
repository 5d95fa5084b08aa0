"""Registered queries over documents, vectors and parts: fingerprints, candidates, matching and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.functions import fingerprints as fp
from foliomatch.functions import text as tx
from foliomatch.functions.labels import work_labels
from foliomatch.operators import candidates as ca
from foliomatch.operators import editions as ed
from foliomatch.operators import graph as gr
from foliomatch.operators import matching as ma
from foliomatch.operators import tables as tb
from foliomatch.plans.stages import materialize
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


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(bi.document_units(spark, sf_dir), "units")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Containers and their probes, which is all that candidates take of the units."""
    return materialize(bi.document_containers(spark, sf_dir), "containers"), bi.document_probes(spark, sf_dir)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    containers, probed = _both(spark, sf_dir)
    return containers, materialize(ca.candidate_seeds(containers, probed, first_id=0, probed=probed), "seeds")


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    containers, seeds = _candidates(spark, sf_dir)
    return containers, _units(spark, sf_dir), seeds


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    containers, units, seeds = _seeds(spark, sf_dir)
    return containers, materialize(ma.classify_pairs(seeds, containers, units), "relations")


def grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    containers, rel = relations(spark, sf_dir)
    groups = materialize(gr.groups_of(rel, ma.usable_edge()), "groups")
    return containers, groups, gr.edges_in_groups(rel, groups)


# ---- shared SQL ---------------------------------------------------------------------------------------------------

SIGNS = "array_to_string(list_transform(range(16), lambda i: format('{:x}', 8 * (embedding[4*i+1] > 0)::INT + 4 * (embedding[4*i+2] > 0)::INT + 2 * (embedding[4*i+3] > 0)::INT + (embedding[4*i+4] > 0)::INT)), '')"


_DIGESTS = "list_transform(range(16), lambda k: md5(array_to_string(w[k * len(w) // 16 + 1 : (k + 1) * len(w) // 16], ' ')))"
_DIGITS = lambda i: f"array_to_string(list_transform(d, lambda x: x[{i}:{i}]), '')"


UNITS = f"""
lines AS (SELECT doc_id AS archive_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
line AS (SELECT archive_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM lines),
split AS (SELECT *, string_split(lower(trim(line)), ' ') AS w FROM line),
hashed AS (SELECT *, {_DIGESTS} AS d FROM split),
units AS MATERIALIZED (
  SELECT archive_id, CAST(pos AS INTEGER) AS pos, sha256(lower(trim(line))) AS pixel, sha256(line) AS byte,
         {_DIGITS(1)} AS dhash, {_DIGITS(2)} AS ahash, CAST(len(line) AS BIGINT) AS area FROM hashed),
sized AS MATERIALIZED (SELECT archive_id, CAST(count(*) AS INTEGER) AS n FROM units GROUP BY archive_id),
"""
CONTAINERS = """
containers AS MATERIALIZED (
  SELECT doc_id AS archive_id, sha256(text) AS file_sha256, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')[1:3]) AS tokens,
         CAST(strlen(text) AS BIGINT) AS file_size, 1700000000000000000 + doc_id * 1000000000 AS mtime_ns,
         array_to_string(string_split(lower(text), ' ')[1:2], ' ') AS series_key, lpad(CAST(n_chars AS VARCHAR), 8, '0') AS series_date,
         lang IN ('en', 'fr') AS series_versioned, '/' || source || '/' || doc_id || '.zip' AS path FROM documents),
"""
# The constants of the pair rank as the definition has them, apart from those of the engine.
_FACTORS = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579)
_MIXERS = (13787848793156543929, 10723151780598845931)
_MASK = (1 << 64) - 1
_START = (1 * _FACTORS[0] & _MASK) ^ (2 * _FACTORS[1] & _MASK)


def _RANK(name: str, source: str) -> str:
    """CTE ``name``: ``source(a, b, ...)`` with the stable rank of root 1 and version 2, in 128-bit arithmetic."""
    big = lambda x: f"CAST({x} AS UHUGEINT)"
    times = lambda x, f: f"(({x}) * {big(f)} % {big(1 << 64)})"
    h0 = f"xor(xor({big(_START)}, {times(big('a'), fp.RANK_FACTORS[2])}), {times(big('b'), fp.RANK_FACTORS[3])})"
    return f"""{name} AS (SELECT * EXCLUDE (h), xor(h, h >> 31) AS rank FROM (SELECT * REPLACE ({times('xor(h, h >> 27)', _MIXERS[1])} AS h) FROM (
  SELECT * REPLACE ({times('xor(h, h >> 30)', _MIXERS[0])} AS h) FROM (SELECT *, {h0} AS h FROM {source}))))"""


PROBES = """
slots AS (
  SELECT archive_id, unnest(p) AS pos, generate_subscripts(p, 1) - 1 AS slot FROM (
    SELECT archive_id, list_sort(list_distinct(list_transform([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], lambda s: CAST(round_even(CAST(n - 1 AS DOUBLE) * CAST(s AS DOUBLE), 0) AS INTEGER)))) AS p FROM sized)),
probes AS (SELECT u.*, CAST(s.slot AS INTEGER) AS slot FROM units u JOIN slots s USING (archive_id, pos)),
"""
KEYS = """
band(i, off, w) AS (VALUES (0, 54, 10), (1, 45, 9), (2, 36, 9), (3, 27, 9), (4, 18, 9), (5, 9, 9), (6, 0, 9)),
keys AS (
  SELECT DISTINCT archive_id, slot, 'pixel' AS kind, pixel AS key FROM probes
  UNION SELECT DISTINCT archive_id, slot, 'byte', byte FROM probes
  UNION SELECT DISTINCT archive_id, slot, 'dhash' || i, CAST((CAST('0x' || dhash AS UBIGINT) >> off) & ((1::UBIGINT << w) - 1) AS VARCHAR) FROM probes, band
  UNION SELECT DISTINCT archive_id, slot, 'ahash' || i, CAST((CAST('0x' || ahash AS UBIGINT) >> off) & ((1::UBIGINT << w) - 1) AS VARCHAR) FROM probes, band),
bucket AS (SELECT slot, kind, key, count(*) AS n FROM keys GROUP BY ALL),
fit AS MATERIALIZED (SELECT k.* FROM keys k JOIN bucket b USING (slot, kind, key) WHERE b.n BETWEEN 2 AND 200),
signals AS MATERIALIZED (
  SELECT DISTINCT l.archive_id AS a, r.archive_id AS b, l.slot, CASE WHEN l.kind IN ('pixel', 'byte') THEN l.kind ELSE 'band' END AS signal
  FROM fit l JOIN fit r ON l.slot = r.slot AND l.kind = r.kind AND l.key = r.key AND l.archive_id < r.archive_id
  JOIN containers x ON x.archive_id = l.archive_id JOIN containers y ON y.archive_id = r.archive_id WHERE x.file_sha256 <> y.file_sha256),
"""
SEEDS = f"""
distinct_pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM signals),
{_RANK('pairs', 'distinct_pairs')},
ends AS (SELECT *, a AS e FROM pairs UNION ALL SELECT *, b FROM pairs),
top AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY rank, a, b) AS nth FROM ends),
mutual AS MATERIALIZED (SELECT a, b FROM top WHERE nth <= 200 GROUP BY a, b HAVING count(*) = 2),
sums AS MATERIALIZED (
  SELECT a, b, count(DISTINCT slot) AS n, count(DISTINCT slot) FILTER (WHERE signal = 'pixel') AS px,
         count(DISTINCT slot) FILTER (WHERE signal = 'byte') AS by_, count(DISTINCT slot) FILTER (WHERE signal = 'band') AS lsh
  FROM signals JOIN mutual USING (a, b) GROUP BY a, b HAVING count(DISTINCT slot) >= 2),
shared AS (
  SELECT s.*, len(list_filter(list_intersect(x.tokens, y.tokens), lambda t: NOT (regexp_full_match(t, '[0-9]+') OR starts_with(t, 'volume') OR starts_with(t, 'chapter')))) > 0 AS tok
  FROM sums s JOIN containers x ON x.archive_id = a JOIN containers y ON y.archive_id = b),
scored AS (
  SELECT a, b, list_filter([CASE WHEN px > 0 THEN 'SAME_PIXEL_SHA256' END, CASE WHEN by_ > 0 THEN 'SAME_BYTE_SHA256' END, CASE WHEN lsh > 0 THEN 'LSH_BAND_MATCH' END, CASE WHEN tok THEN 'SHARED_FILENAME_TOKEN_WITH_VISUAL_HIT' END], lambda x: x IS NOT NULL) AS reasons,
         CAST(30 * px + 25 * by_ + 8 * lsh + CASE WHEN tok THEN 2 ELSE 0 END AS INTEGER) AS score, rank FROM shared JOIN pairs USING (a, b)),
ends2 AS (SELECT *, a AS e FROM scored UNION ALL SELECT *, b FROM scored),
top2 AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, rank, a, b) AS nth FROM ends2),
visual AS MATERIALIZED (SELECT a, b, any_value(reasons) AS reasons, any_value(score) AS score FROM top2 WHERE nth <= 100 GROUP BY a, b HAVING count(*) = 2),
sha AS (SELECT file_sha256, min(archive_id) AS a FROM containers GROUP BY 1),
exact AS (SELECT s.a, c.archive_id AS b, ['SAME_ARCHIVE_SHA256'] AS reasons, 100 AS score FROM containers c JOIN sha s USING (file_sha256) WHERE c.archive_id > s.a),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM visual),
versioned AS (SELECT *, max(series_versioned::INT) OVER (PARTITION BY series_key) AS v FROM containers WHERE series_key <> ''),
neighbours AS (SELECT archive_id AS x, lag(archive_id) OVER (PARTITION BY series_key ORDER BY series_date, mtime_ns, archive_id) AS y FROM versioned WHERE v = 1),
dated AS (SELECT least(x, y) AS a, greatest(x, y) AS b FROM neighbours WHERE y IS NOT NULL),
seeds AS MATERIALIZED (
  SELECT coalesce(f.a, d.a) AS a, coalesce(f.b, d.b) AS b, list_concat(coalesce(f.reasons, []), CASE WHEN d.a IS NOT NULL THEN ['DATED_SERIES_TITLE'] ELSE [] END) AS reasons, coalesce(f.score, 0) AS score
  FROM found f FULL JOIN dated d ON f.a = d.a AND f.b = d.b),
"""
MATCH = """
p AS (SELECT a, b, reasons FROM seeds),
ps AS (SELECT *, unnest([-2, -1, 0, 1, 2]) AS shift FROM p),
num AS MATERIALIZED (SELECT archive_id, pos, pixel, area, CAST('0x' || dhash AS UBIGINT) AS h FROM units),
lefts AS MATERIALIZED (SELECT ps.a, ps.b, ps.shift, l.pos AS lp, l.pos + ps.shift AS at, l.area AS la, l.pixel, l.h FROM ps JOIN num l ON l.archive_id = ps.a),
lr AS MATERIALIZED (
  SELECT l.a, l.b, l.shift, l.lp, r.pos AS rp, l.la, r.area AS ra, l.pixel = r.pixel AS same
  FROM lefts l JOIN num r ON r.archive_id = l.b AND r.pos = l.at
  WHERE l.pixel = r.pixel OR bit_count(xor(l.h, r.h)) <= 6),
by_shift AS MATERIALIZED (SELECT a, b, shift, count(*) AS matched, median(la) AS lm, median(ra) AS rm FROM lr GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY matched DESC, abs(shift), shift) AS nth FROM by_shift) WHERE nth = 1),
equal AS MATERIALIZED (SELECT a, b, count(*) AS eq FROM lr WHERE shift = 0 AND same GROUP BY ALL),
bagc AS MATERIALIZED (SELECT archive_id, pixel, count(*) AS n FROM units GROUP BY ALL),
bag AS MATERIALIZED (SELECT p.a, p.b, CAST(sum(least(l.n, r.n)) AS INTEGER) AS common FROM p JOIN bagc l ON l.archive_id = p.a JOIN bagc r ON r.archive_id = p.b AND r.pixel = l.pixel WHERE list_contains(p.reasons, 'DATED_SERIES_TITLE') GROUP BY ALL),
facts AS MATERIALIZED (
  SELECT p.*, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb, ca.file_sha256 = cb.file_sha256 AS copies, coalesce(best.matched, 0) AS m, coalesce(best.shift, 0) AS shift, lm, rm, coalesce(eq, 0) AS eq, coalesce(common, 0) AS common
  FROM p LEFT JOIN sized x ON x.archive_id = p.a LEFT JOIN sized y ON y.archive_id = p.b JOIN containers ca ON ca.archive_id = p.a JOIN containers cb ON cb.archive_id = p.b
  LEFT JOIN best ON best.a = p.a AND best.b = p.b LEFT JOIN equal ON equal.a = p.a AND equal.b = p.b LEFT JOIN bag ON bag.a = p.a AND bag.b = p.b),
rules AS (
  SELECT *, CASE WHEN greatest(na, nb) > 0 THEN m / greatest(na, nb) ELSE 0.0 END AS share, CASE WHEN least(na, nb) > 0 THEN common / least(na, nb) ELSE 0.0 END AS cover,
         na = nb AND na > 0 AND eq = na AS in_order FROM facts),
kinds AS (SELECT *, share >= 0.9 AND abs(na - nb) <= greatest(2, ceil(greatest(na, nb) * 0.05)) AND m >= 3 AS variant, common >= 3 AND cover >= 0.8 AS series FROM rules),
relations AS (
  SELECT a, b, CASE WHEN copies THEN 'EXACT_ARCHIVE' WHEN in_order THEN 'EXACT_CONTENT' WHEN variant THEN 'VISUAL_VARIANT' ELSE 'RELATED' END AS relation,
         CASE WHEN copies OR in_order THEN 1.0 WHEN variant THEN share WHEN series THEN cover ELSE share END AS confidence,
         CAST(CASE WHEN copies THEN least(na, nb) WHEN in_order THEN na WHEN variant THEN m WHEN series THEN common ELSE m END AS INTEGER) AS matched, na, nb, shift, reasons,
         CASE WHEN copies THEN 'MANUAL_EQUIVALENT_PATHS' WHEN in_order OR variant THEN CASE WHEN lm >= rm * 1.15 THEN 'KEEP_LEFT_HIGHER_RESOLUTION' WHEN rm >= lm * 1.15 THEN 'KEEP_RIGHT_HIGHER_RESOLUTION' ELSE 'MANUAL' END ELSE 'MANUAL' END AS recommendation
  FROM kinds),
"""
COMPONENTS = """
usable AS (SELECT a, b FROM relations WHERE relation <> 'RELATED' OR (matched >= 2 AND confidence >= 0.5)),
hop AS (SELECT a AS x, b AS y FROM usable UNION SELECT b, a FROM usable),
reach AS (SELECT x AS node, x AS near FROM hop UNION SELECT r.node, h.y FROM reach r JOIN hop h ON h.x = r.near),
groups AS (SELECT node AS archive_id, min(near) AS component FROM reach GROUP BY node),
edges AS (SELECT r.*, l.component FROM relations r JOIN groups l ON l.archive_id = r.a JOIN groups g ON g.archive_id = r.b WHERE l.component = g.component),
"""
_ALL = "WITH RECURSIVE " + CONTAINERS + UNITS + PROBES + KEYS + SEEDS + MATCH + COMPONENTS


def _sql(prefix: str, last: str) -> str:
    return prefix.rstrip().rstrip(",") + "\n" + last


_TO_SIGNALS = "WITH " + CONTAINERS + UNITS + PROBES + KEYS
_TO_SEEDS = _TO_SIGNALS + SEEDS
_TO_MATCH = _TO_SEEDS + MATCH

# ---- functions ----------------------------------------------------------------------------------------------------


@query(f"""
WITH h AS (SELECT vec_id AS archive_id, {SIGNS} AS dhash FROM embeddings)
SELECT l.archive_id, l.dhash, CAST(bit_count(xor(CAST('0x' || l.dhash AS UBIGINT), CAST('0x' || r.dhash AS UBIGINT))) AS INTEGER) AS distance
FROM h l JOIN h r ON r.archive_id = l.archive_id + 1""")
def f02_f04_sign_hash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bi.vector_hashes(spark, sf_dir)
    near = h.select((F.col("archive_id") - 1).alias("archive_id"), F.col("dhash").alias("other"))
    distance = fp.hamming(fp.hash_to_long(F.col("dhash")), fp.hash_to_long(F.col("other")))
    return h.join(near, "archive_id").select("archive_id", "dhash", distance.cast("int").alias("distance"))


@query(_sql("WITH " + UNITS + PROBES, "SELECT archive_id, CAST(slot AS INTEGER) AS slot, pos FROM slots"))
def f05_probe_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.probes(_units(spark, sf_dir)).select("archive_id", "slot", "pos")


@query("""
SELECT n, array_to_string(CASE WHEN n <= 12 THEN range(n) ELSE list_sort(list_distinct(list_transform(range(12), lambda i: CAST(round_even(i * (n - 1) / 11, 0) AS BIGINT)))) END, ',') AS positions
FROM (SELECT DISTINCT p_size AS n FROM part)""")
def f06_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bi.table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    return sizes.select("n", F.array_join(F.transform(fp.even_sample(F.col("n")), lambda x: x.cast("string")), ",").alias("positions"))


@query("""
WITH RECURSIVE s AS (SELECT DISTINCT p_size AS n FROM part),
p AS (SELECT n, m, CASE WHEN n >= 5 THEN range(1, n - 1) ELSE range(0, n) END AS pool FROM s, (VALUES (3), (6), (12)) AS t(m)),
r AS (
  SELECT n, m, pool, CAST([] AS BIGINT[]) AS chosen FROM p
  UNION ALL SELECT n, m, pool, list_append(chosen, list_sort(list_transform(list_filter(pool, lambda x: NOT list_contains(chosen, x)),
    lambda x: {'g': -coalesce(list_min(list_transform(chosen, lambda c: abs(c - x))), 1000000), 'd': abs(2 * x - pool[1] - pool[-1]), 'x': x}))[1].x)
  FROM r WHERE len(chosen) < least(m, len(pool)))
SELECT n, CAST(m AS INTEGER) AS "limit", array_to_string(list_sort(chosen), ',') AS positions FROM r WHERE len(chosen) = least(m, len(pool))""")
def f07_interior_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bi.table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    limits = sizes.select("n", F.explode(F.array(F.lit(3), F.lit(6), F.lit(12))).alias("limit"))
    return limits.select("n", "limit", F.array_join(F.transform(fp.interior_sample(F.col("n"), F.col("limit")), lambda x: x.cast("string")), ",").alias("positions"))


@query(f"""
WITH h AS (SELECT vec_id AS archive_id, CAST('0x' || {SIGNS} AS UBIGINT) AS v FROM embeddings),
band(i, off, w) AS (VALUES (0, 54, 10), (1, 45, 9), (2, 36, 9), (3, 27, 9), (4, 18, 9), (5, 9, 9), (6, 0, 9))
SELECT archive_id, CAST(i AS INTEGER) AS band, CAST((v >> off) & ((1::UBIGINT << w) - 1) AS BIGINT) AS key FROM h, band""")
def f08_lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.vector_hashes(spark, sf_dir).select("archive_id", F.inline(fp.bands(fp.hash_to_long(F.col("dhash")))))


@query(f"""
WITH p AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings),
{_RANK('r', 'p')}
SELECT a, b, CAST(CAST(rank AS HUGEINT) - 9223372036854775808::HUGEINT AS BIGINT) AS rank FROM r""")
def f10_stable_pair_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bi.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return fp.with_pair_rank(e, name="rank")


@query(r"""
WITH t AS (SELECT p_partkey, p_size, '[' || p_brand || ' (' || p_type || ')] ' || p_name || ' v' || p_size || CASE p_size % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.cbz' WHEN 2 THEN '.txt' ELSE '' END AS path,
  ['/a/[x (y)] z', '/a/［x（y）］ z', '/a/[x] z', '/a/z [x]', '/a/[x]', '/a/ ', '/a/[x (y)]'][CAST(p_partkey % 7 AS INTEGER) + 1] || p_name || '.zip' AS title,
  ['a/', '../', '/', 'c:', 'a//', './', ''][CAST(p_partkey % 7 AS INTEGER) + 1] || p_name AS member FROM part),
s AS (SELECT *, translate(regexp_extract(title, '/([^/]*)\.zip$', 1), '［］（）', '[]()') AS stem, string_split(member, '/') AS parts FROM t)
SELECT p_partkey, CASE WHEN trim(stem) = '' THEN 0 WHEN regexp_matches(stem, '^\[[^\[\]()]+\s*\([^()]+\)\]\s*\S') THEN 3 WHEN regexp_matches(stem, '^\[[^\[\]]+\]\s*\S') THEN 2 ELSE 1 END AS title_rank,
       CASE WHEN path LIKE '%.jpg' THEN 'IMAGE' WHEN path LIKE '%.cbz' THEN 'NESTED_ARCHIVE' ELSE 'OTHER' END AS kind,
       CASE WHEN path LIKE '%.cbz' THEN 'cbz' END AS format, NOT contains(member, ':') AND len(list_filter(parts, lambda x: x IN ('', '.', '..'))) = 0 AS safe, lpad(lower(format('{:x}', p_partkey)), 8, '0') AS crc,
       CASE WHEN p_partkey * 256 >= 1048576 THEN format('{:.1f} MiB', p_partkey * 256 / 1048576) WHEN p_partkey * 256 >= 1024 THEN format('{:.1f} KiB', p_partkey * 256 / 1024) ELSE format('{:,} B', p_partkey * 256) END AS size_text
FROM s""")
def p05_p22_path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = bi.table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    end = F.when(F.col("p_size") % 4 == 0, ".jpg").when(F.col("p_size") % 4 == 1, ".cbz").when(F.col("p_size") % 4 == 2, ".txt").otherwise("")
    path = F.concat(F.lit("["), "p_brand", F.lit(" ("), "p_type", F.lit(")] "), "p_name", F.lit(" v"), F.col("p_size").cast("string"), end)
    title = F.concat(pick("/a/[x (y)] z", "/a/［x（y）］ z", "/a/[x] z", "/a/z [x]", "/a/[x]", "/a/ ", "/a/[x (y)]"), "p_name", F.lit(".zip"))
    member = F.concat(pick("a/", "../", "/", "c:", "a//", "./", ""), "p_name")
    return p.select(
        "p_partkey", tx.title_rank(title).alias("title_rank"), tx.entry_kind(path).alias("kind"), tx.archive_format(path).alias("format"), tx.is_safe_member(member).alias("safe"), tx.crc_hex(F.concat(F.lit("0x"), F.hex(key))).alias("crc"), tx.file_size_text(key * 256).alias("size_text")
    )


@query(r"""
WITH k AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_size || '.jpg'), '([0-9]+|[^0-9]+)') AS k FROM part)
SELECT p_partkey, array_to_string(list_transform(k, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0:' || CAST(x AS BIGINT) ELSE '1:' || x END), '|') AS key FROM k""")
def p04_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".jpg"))
    parts = F.transform(tx.natural_key(name), lambda p: F.concat(p["is_text"].cast("string"), F.lit(":"), F.coalesce(p["text"], p["number"].cast("string"))))
    return bi.table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "|").alias("key"))


# Words of the definition that these titles can hold, apart from the tables of the engine.
_LANGUAGES = {"korean": "KOREAN", "korea": "KOREAN", "kor": "KOREAN", "kr": "KOREAN", "japanese": "JAPANESE", "japan": "JAPANESE", "jpn": "JAPANESE", "jp": "JAPANESE",
              "english": "ENGLISH", "eng": "ENGLISH", "chinese": "CHINESE", "chs": "CHINESE", "cht": "CHINESE", "zh": "CHINESE"}
_COLORS = {"fullcolor": "FULL_COLOR", "full color": "FULL_COLOR", "color": "FULL_COLOR", "colour": "FULL_COLOR", "monochrome": "MONOCHROME", "grayscale": "MONOCHROME", "black white": "MONOCHROME", "bw": "MONOCHROME"}
_MOSAICS = {"uncensored": "UNCENSORED", "no mosaic": "UNCENSORED", "decensored": "DECENSORED", "censored": "CENSORED", "mosaic": "CENSORED"}
_NO_TOKENS = ("scan", "scanned", "resize", "resized", *_LANGUAGES)


def _said(table: dict[str, str]) -> str:
    rows = ", ".join(f"{{'w': ' {w} ', 'v': '{v}'}}" for w, v in table.items())
    return f"list_distinct(list_transform(list_filter([{rows}], lambda p: contains(t, p.w)), lambda p: p.v))"


@query(rf"""
WITH n AS (SELECT p_partkey, lower('[' || p_brand || '] ' || p_name || ' vol.' || p_size || ' (' || ['korean', 'english full color', 'japan bw', 'uncensored scan', 'kor eng'][CAST(p_partkey % 5 AS INTEGER) + 1] || ')') AS x FROM part),
v AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(x, '[\[\]()_-]', ' ', 'g'), '(?:vol(?:ume)?|v)\.?\s*0*(\d+)\b', ' volume\1 ', 'g'), '(?:ch(?:apter)?)\.?\s*0*(\d+)\b', ' chapter\1 ', 'g') AS x FROM n),
w AS (SELECT p_partkey, list_distinct(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+')) AS w, ' ' || array_to_string(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM v),
e AS (SELECT *, {_said(_LANGUAGES)} AS l, {_said(_COLORS)} AS c, {_said(_MOSAICS)} AS m FROM w)
SELECT p_partkey, CASE WHEN len(l) = 1 THEN l[1] END AS value, len(l) > 1 AS conflict, CASE WHEN len(c) = 1 THEN c[1] END AS color, CASE WHEN len(m) = 1 THEN m[1] END AS mosaic,
       CAST(len(list_filter(w, lambda x: NOT list_contains([{', '.join(f"'{w}'" for w in _NO_TOKENS)}], x))) AS INTEGER) AS n_tokens FROM e""")
def p06_filename_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(x) for x in ("korean", "english full color", "japan bw", "uncensored scan", "kor eng")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/x/["), "p_brand", F.lit("] "), "p_name", F.lit(" vol."), F.col("p_size").cast("string"), F.lit(" ("), words, F.lit(").zip"))
    return bi.table(spark, sf_dir, "part").select("p_partkey", tx.filename_evidence(path).alias("e")).select("p_partkey", "e.language.value", "e.language.conflict", F.col("e.color.value").alias("color"), F.col("e.mosaic.value").alias("mosaic"), F.size("e.tokens").alias("n_tokens"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 8 AS INTEGER) AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 5 THEN 'order ' || strftime(d, '%Y %m') || ' 32' WHEN 6 THEN 'order ' || strftime(d, '%Y') ELSE 'order' END AS key,
       CASE WHEN k = 3 THEN CAST(make_date(CAST(year(d) AS INTEGER), 1, 1) AS VARCHAR) WHEN k = 2 THEN CAST(date_trunc('month', d)::DATE AS VARCHAR) WHEN k < 5 THEN CAST(d AS VARCHAR) ELSE '' END AS "start",
       CASE WHEN k = 3 THEN CAST(make_date(CAST(year(d) AS INTEGER) + 1, 12, 31) AS VARCHAR) WHEN k = 2 THEN CAST(last_day(d) AS VARCHAR) WHEN k = 4 THEN CAST(d + 40 AS VARCHAR) WHEN k < 5 THEN CAST(d AS VARCHAR) ELSE '' END AS "end", k IN (3, 4) AS is_range, k NOT IN (5, 6) AS versioned FROM o""")
def p10_title_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = bi.table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    year = F.date_format(d, "yyyy")
    forms = [
        F.concat(F.lit("["), F.date_format(d, "yyyy-MM-dd"), F.lit("]")), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy.M"), F.concat(year, F.lit(" ~ "), (year.cast("int") + 1).cast("string")),
        F.concat(F.date_format(d, "yyyy/M/d"), F.lit(" – "), F.date_format(F.date_add(d, 40), "yyyyMMdd")), F.concat(F.date_format(d, "yyyy-MM"), F.lit("-32")), year, F.lit("ongoing"),
    ]
    form = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    t = o.select("o_orderkey", tx.title_dates(F.concat(F.lit("Order "), F.regexp_replace(form, "/", "."), F.lit(".zip"))).alias("t"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c[2:])
    return t.select("o_orderkey", "t.key", text("t.start"), text("t.end"), "t.is_range", "t.versioned")


_COUNTS = r"""
counts AS (
  SELECT doc_id AS archive_id, CAST(len(regexp_replace(text, '[^\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]', '', 'g')) AS BIGINT) AS korean,
         CAST(len(regexp_replace(text, '[^\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{31F0}-\x{31FF}\x{FF66}-\x{FF6F}\x{FF71}-\x{FF9D}]', '', 'g')) AS BIGINT) AS japanese,
         CAST(len(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]', '', 'g')) AS BIGINT) AS chinese,
         CAST(len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS english,
         CAST(len(regexp_replace(text, '[\P{L}\x00-\x7F]', '', 'g')) AS BIGINT) AS other FROM documents)
"""


@query("WITH " + _COUNTS + """
SELECT *, CASE WHEN japanese > 0 THEN 'JAPANESE' WHEN greatest(english, other) < 4 THEN 'UNKNOWN' WHEN english >= other THEN CASE WHEN other >= 4 AND english < 1.5 * other THEN 'UNKNOWN' ELSE 'ENGLISH' END
       WHEN english >= 4 AND other < 1.5 * english THEN 'UNKNOWN' ELSE 'OTHER' END AS language FROM counts""")
def a10_container_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bi.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive_id"), F.lit(0).alias("pos"), "text")
    out = ed.container_language(ed.page_language(d))
    return out.select("archive_id", "language", *[F.col(k).cast("long").alias(k.lower()) for k in ed.LANGUAGES])


# ---- candidates ---------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS a FROM documents) SELECT a, doc_id AS b FROM c WHERE doc_id > a")
def c03_exact_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.exact_star_seeds(bi.document_containers(spark, sf_dir))


@query(_sql(_TO_SIGNALS, "SELECT slot, kind, key, n FROM bucket WHERE n > 1"))
def c04_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ca.bucket_keys(bi.document_probes(spark, sf_dir))
    return keys.groupBy("slot", "kind", "key").agg(F.count("*").alias("n")).where("n > 1")


@query(_sql(_TO_SIGNALS, "SELECT a, b, slot, signal FROM signals"))
def c05_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.signals(*_both(spark, sf_dir))


@query(_sql(_TO_SIGNALS, f""", s0 AS (SELECT a, b, count(DISTINCT slot) AS n FROM signals GROUP BY a, b),
{_RANK('s', 's0')},
e AS (SELECT *, a AS e FROM s UNION ALL SELECT *, b FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, rank, a, b) AS nth FROM e)
SELECT a, b FROM t WHERE nth <= 3 GROUP BY a, b HAVING count(*) = 2"""))
def c06_mutual_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ca.observed_pairs(*_both(spark, sf_dir)).select("a", "b", ca.support().alias("n"))
    return ca.mutual_top(materialize(fp.with_pair_rank(s), "pairs"), 3, F.desc("n"), F.col("_rank")).select("a", "b")


@query(_sql(_TO_SEEDS, "SELECT a, b, array_to_string(reasons, ',') AS reasons, CAST(score AS INTEGER) AS score FROM seeds"))
def c01_candidate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[1].select("a", "b", F.array_join("reasons", ",").alias("reasons"), "score")


@query(_sql(_TO_SEEDS, "SELECT a, b FROM dated"))
def c10_dated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.dated_series_pairs(bi.document_containers(spark, sf_dir))


@query(_sql(_TO_SIGNALS, """, n AS (SELECT e, count(*) AS n FROM (SELECT DISTINCT a, b, a AS e FROM signals UNION SELECT DISTINCT a, b, b FROM signals) GROUP BY e)
SELECT (SELECT count(*) FROM bucket WHERE n > 200) AS discarded_buckets, (SELECT count(*) FROM signals) AS observations, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM signals)) AS pairs,
       (SELECT CAST(coalesce(sum(greatest(n - 200, 0)), 0) AS BIGINT) FROM n) AS over_cap, (SELECT coalesce(max(n), 0) FROM n) AS most_pairs"""))
def a17_candidate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, probed = _both(spark, sf_dir)
    return ca.diagnostics(containers, probed, first_id=0, probed=probed)


# ---- matching -----------------------------------------------------------------------------------------------------


@query(_sql(_TO_MATCH, "SELECT a, b, shift, matched FROM best"))
def c18_best_fixed_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, seeds = _seeds(spark, sf_dir)
    return ma.best_fixed_offset(ma.fixed_offset_matches(seeds, units)).select("a", "b", F.col("shift").cast("int").alias("shift"), F.col("matched").cast("long").alias("matched"))


@query(_sql(_TO_MATCH, "SELECT a, b, common FROM bag"))
def c19_bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, seeds = _seeds(spark, sf_dir)
    return ma.bag_overlap(seeds.where(F.array_contains("reasons", ca.SERIES_REASON)), units)


@query(_sql(_TO_MATCH, "SELECT a, b, relation, round(confidence, 6) AS confidence, matched, na, nb, recommendation FROM relations"))
def m01_classified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rel = relations(spark, sf_dir)
    return rel.select("a", "b", "relation", F.round("confidence", 6).alias("confidence"), "matched", "na", "nb", "recommendation")


_SEQUENCE = """
kb(i, off, w) AS (VALUES (0, 54, 10), (1, 45, 9), (2, 36, 9), (3, 27, 9), (4, 18, 9), (5, 9, 9), (6, 0, 9)),
uk AS (SELECT archive_id, pos, pixel AS key FROM units UNION SELECT archive_id, pos, i || ':' || ((CAST('0x' || dhash AS UBIGINT) >> off) & ((1::UBIGINT << w) - 1)) FROM units, kb),
rk AS (SELECT archive_id, key, count(*) AS n FROM uk GROUP BY ALL),
al AS (
  SELECT DISTINCT p.a, p.b, CAST(y.pos - x.pos AS INTEGER) AS offs, x.pos AS lp, y.pos AS rp
  FROM seeds p JOIN uk x ON x.archive_id = p.a JOIN uk y ON y.archive_id = p.b AND y.key = x.key JOIN rk ON rk.archive_id = p.b AND rk.key = x.key AND rk.n <= 200
  JOIN units l ON l.archive_id = x.archive_id AND l.pos = x.pos JOIN units r ON r.archive_id = y.archive_id AND r.pos = y.pos
  WHERE l.pixel = r.pixel OR bit_count(xor(CAST('0x' || l.dhash AS UBIGINT), CAST('0x' || r.dhash AS UBIGINT))) <= 6),
ao AS (SELECT a, b, offs, CAST(count(*) AS INTEGER) AS matched, count(*) / (max(lp) - min(lp) + 1) AS density FROM al GROUP BY ALL),
ab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY matched DESC, density DESC, abs(offs), offs) AS nth FROM ao) WHERE nth = 1),
sq AS (SELECT ab.*, x.n AS na, y.n AS nb, matched / x.n AS ls, matched / y.n AS rs FROM ab JOIN sized x ON x.archive_id = a JOIN sized y ON y.archive_id = b),
sr AS (
  SELECT *, CASE WHEN ls >= 0.9 AND rs >= 0.9 AND abs(na - nb) <= greatest(2, ceil(greatest(na, nb) * 0.05)) THEN NULL
                 WHEN matched >= 3 AND greatest(ls, rs) >= 0.9 AND greatest(na, nb) >= least(na, nb) + 2 THEN 'CONTAINS' WHEN matched >= 5 AND greatest(ls, rs) >= 0.3 THEN 'PARTIAL_OVERLAP' END AS relation FROM sq)
"""


@query(_sql(_TO_SEEDS, "," + _SEQUENCE + "SELECT a, b, relation, CASE WHEN relation = 'CONTAINS' THEN CASE WHEN na > nb THEN a ELSE b END ELSE -1 END AS container, matched, round(ls, 6) AS left_share, round(rs, 6) AS right_share FROM sr WHERE relation IS NOT NULL"))
def m08_sequence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, seeds = _seeds(spark, sf_dir)
    out = ma.sequence_relations(seeds, units)
    return out.select("a", "b", "relation", F.coalesce("container", F.lit(-1).cast("long")).alias("container"), "matched", F.round("left_share", 6).alias("left_share"), F.round("right_share", 6).alias("right_share"))


@query(_sql(_TO_SEEDS, "," + _SEQUENCE + "SELECT a, b, CAST(na - matched AS INTEGER) AS n_left, CAST(nb - matched AS INTEGER) AS n_right FROM sr WHERE relation IS NOT NULL"))
def m15_unmatched_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, seeds = _seeds(spark, sf_dir)
    out = ma.unmatched_units(ma.sequence_relations(seeds, units))
    return out.select("a", "b", F.size("left_rest").alias("n_left"), F.size("right_rest").alias("n_right"))


# ---- groups -------------------------------------------------------------------------------------------------------


@query(_sql(_ALL, "SELECT archive_id, component FROM groups"))
def g01_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir)[1].select("archive_id", "component")


@query(_sql(_ALL, """, best_rank AS (SELECT component, min(list_position(['EXACT_ARCHIVE', 'EXACT_CONTENT', 'VISUAL_VARIANT', 'RELATED'], relation)) AS r FROM edges GROUP BY component)
SELECT e.component, min(relation) AS relation, round(max(confidence), 6) AS confidence FROM edges e JOIN best_rank b ON b.component = e.component AND list_position(['EXACT_ARCHIVE', 'EXACT_CONTENT', 'VISUAL_VARIANT', 'RELATED'], relation) = b.r GROUP BY e.component"""))
def a04_strongest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.strongest_edges(grouped(spark, sf_dir)[2]).select("component", "relation", F.round("confidence", 6).alias("confidence"))


@query(_sql(_ALL, """, w AS (SELECT component, CASE WHEN starts_with(recommendation, 'KEEP_LEFT') THEN a WHEN starts_with(recommendation, 'KEEP_RIGHT') THEN b END AS w FROM edges)
SELECT component, CASE WHEN count(*) = count(w) AND count(DISTINCT w) = 1 THEN min(w) ELSE -1 END AS archive_id FROM w GROUP BY component"""))
def a05_recommended_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.recommended_member(grouped(spark, sf_dir)[2]).select("component", F.coalesce("archive_id", F.lit(-1).cast("long")).alias("archive_id"))


@query(_sql(_ALL, """, l AS (SELECT component, relation, count(*) AS n, max(confidence) AS c FROM edges GROUP BY ALL)
SELECT component, round(max(c), 6) AS confidence, array_to_string(list_sort(list(relation || ' ' || n)), ' / ') AS labels FROM l GROUP BY component"""))
def a15_group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.label_counts(grouped(spark, sf_dir)[2]).select("component", F.round("confidence", 6).alias("confidence"), "labels")


@query(_sql(_ALL, "SELECT component, count(*) AS members, sha256('1:' || array_to_string(list_sort(list(archive_id)), ',')) AS group_key FROM groups GROUP BY component"))
def f18_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)[1]
    return g.groupBy("component").agg(F.count("*").alias("members"), fp.group_key(F.lit(1), F.collect_list("archive_id")).alias("group_key"))


@query(_sql(_ALL, """, x AS (SELECT component, a AS archive_id, b AS other, relation, confidence FROM edges UNION ALL SELECT component, b, a, relation, confidence FROM edges),
t AS (SELECT component, archive_id, array_to_string(list_sort(list(lpad(CAST(other AS VARCHAR), 12, '0') || ':' || relation || ':' || format('{:.4f}', round(confidence, 4)))), '; ') AS edges FROM x GROUP BY ALL)
SELECT g.component, g.archive_id, c.path, coalesce(t.edges, '') AS edges FROM groups g LEFT JOIN t USING (component, archive_id) JOIN containers c ON c.archive_id = g.archive_id"""))
def k02_member_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, groups, edges = grouped(spark, sf_dir)
    return tb.member_report(groups, edges, containers)


@query("""
WITH s AS (SELECT doc_id AS archive_id, (strlen(text) % 100) / 100.0 AS score FROM documents UNION ALL SELECT doc_id, (n_chars % 50) / 100.0 FROM documents)
SELECT archive_id, CAST(count(*) AS INTEGER) AS sample_count, avg((score >= 0.08)::INT::DOUBLE) AS color_page_ratio, round(median(CAST(score AS DOUBLE)), 6) AS median_color_score,
       CASE WHEN avg((score >= 0.08)::INT::DOUBLE) >= 0.5 THEN 'FULL_COLOR' WHEN avg((score >= 0.08)::INT::DOUBLE) <= 0.15 THEN 'MONOCHROME' ELSE 'MIXED_OR_UNKNOWN' END AS kind FROM s GROUP BY archive_id""")
def a08_edition_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bi.table(spark, sf_dir, "documents")
    scores = d.select(F.col("doc_id").alias("archive_id"), F.explode(F.array((F.octet_length("text") % 100) / 100.0, (F.col("n_chars") % 50) / 100.0)).alias("score"))
    return ed.edition_profiles(scores).withColumn("median_color_score", F.round("median_color_score", 6))


@query(_sql(_ALL, """, best_rank AS (SELECT component, min(list_position(['EXACT_ARCHIVE', 'EXACT_CONTENT', 'VISUAL_VARIANT', 'RELATED'], relation)) AS r FROM edges GROUP BY component)
SELECT ['EXACT_ARCHIVE', 'EXACT_CONTENT', 'VISUAL_VARIANT', 'RELATED'][r] AS relation, count(*) AS groups FROM best_rank GROUP BY r"""))
def a07_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.relation_counts(grouped(spark, sf_dir)[2])


@query(_sql(_ALL, """, n AS (SELECT component, count(*) AS edges FROM edges GROUP BY component)
SELECT g.component, count(*) AS members, CAST(sum(c.file_size) AS BIGINT) AS bytes, arg_max(c.archive_id, c.mtime_ns) AS newest, any_value(coalesce(n.edges, 0)) AS edges, array_to_string(list_sort(list(c.archive_id)), ',') AS ids
FROM groups g JOIN containers c USING (archive_id) LEFT JOIN n ON n.component = g.component GROUP BY g.component"""))
def d08_group_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, groups, edges = grouped(spark, sf_dir)
    out = gr.group_details(groups, edges, containers)
    return out.select("component", "members", "bytes", "newest", "edges", F.array_join(F.transform("list", lambda m: m["archive_id"].cast("string")), ",").alias("ids"))


@query(_sql(_ALL, "SELECT DISTINCT g.component FROM groups g JOIN containers c USING (archive_id) WHERE contains(lower(c.path), 'src1/')"))
def w09_group_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers, groups, _ = grouped(spark, sf_dir)
    paths = groups.join(containers.select("archive_id", "path"), "archive_id")
    return paths.where(tx.search_text(F.col("path")).contains("src1/")).select("component").distinct()


_JOINED = lambda c: f"array_to_string(list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i), ' / ')"


@query(f"""
WITH g AS (SELECT p_partkey % 50 AS component, list(trim(p_brand) ORDER BY p_partkey) AS a, list(trim(regexp_replace(p_name, '\\s+', ' ', 'g')) ORDER BY p_partkey) AS t, list(trim(p_type) ORDER BY p_partkey) AS k FROM part GROUP BY 1)
SELECT component, '[ㅁㅁㅁㅁ(' || {_JOINED('a')} || ')] ' || {_JOINED('t')} || ' (' || {_JOINED('k')} || ')' AS label FROM g""")
def p13_work_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bi.table(spark, sf_dir, "part")
    path = F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", F.lit(" ("), "p_type", F.lit(").zip"))
    return work_labels(p.select((F.col("p_partkey") % 50).alias("component"), F.col("p_partkey").alias("at"), path.alias("path")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents with their strongest relation, size and key."""
    _, groups, edges = grouped(spark, sf_dir)
    keys = groups.groupBy("component").agg(F.count("*").alias("members"), fp.group_key(F.lit(1), F.collect_list("archive_id")).alias("group_key"))
    return keys.join(gr.strongest_edges(edges), "component")
