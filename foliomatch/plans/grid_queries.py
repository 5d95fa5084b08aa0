"""Registered queries over embeddings as pixel grids of 8 by 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.functions import grids
from foliomatch.operators import editions as ed
from foliomatch.plans.stages import materialize
from foliomatch.sources import bindings as bi

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHAPE = (8, 8)


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pages: eight to a container."""
    e = bi.table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).alias("archive_id"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("grid"))


def _grey(pages: DataFrame) -> DataFrame:
    level = F.transform("grid", lambda v: F.least(F.greatest(F.floor(v * 512 + 128), F.lit(0)), F.lit(255)).cast("double"))
    return pages.withColumn("grid", level)


_GRID = """
e AS (SELECT vec_id // 8 AS archive_id, CAST(vec_id % 8 AS INTEGER) AS pos, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
"""
# steps to the right (8 rows of 7) and down (7 rows of 8), then what lies around each of the 6 by 6 inner pixels
_STEPS = _GRID + """
s AS (SELECT *, list_transform(range(56), lambda k: abs(x[(k // 7) * 8 + k % 7 + 2] - x[(k // 7) * 8 + k % 7 + 1])) AS across,
             list_transform(range(56), lambda k: abs(x[k + 9] - x[k + 1])) AS down,
             list_transform(range(36), lambda k: (k // 6 + 1) * 8 + k % 6 + 2) AS inner_at FROM e),
m AS (SELECT *, list_transform(inner_at, lambda p: x[p - 1] + x[p + 1] + x[p - 8] + x[p + 8]) AS around,
             list_transform(inner_at, lambda p: x[p]) AS middle,
             list_transform(range(36), lambda k: greatest(across[(k // 6 + 1) * 7 + k % 6 + 1], down[(k // 6) * 8 + k % 6 + 2])) AS gradient FROM s),
r AS (SELECT *, list_transform(range(36), lambda k: middle[k + 1] - around[k + 1] / 4) AS rest,
             list_transform(range(36), lambda k: around[k + 1] - 4 * middle[k + 1]) AS bend,
             list_aggregate(gradient, 'quantile_cont', 0.9) AS p90, list_aggregate(gradient, 'quantile_cont', 0.75) AS p75 FROM m),
t AS (SELECT *, list_transform(range(36), lambda k:
        (k % 6 < 5 AND rest[k + 1] * rest[k + 2] < 0) OR (k % 6 > 0 AND rest[k + 1] * rest[k] < 0)
        OR (k < 30 AND rest[k + 1] * rest[k + 7] < 0) OR (k > 5 AND rest[k + 1] * rest[k - 5] < 0)) AS turning,
      list_transform(range(4), lambda b: list_aggregate(list_transform(range(16), lambda k: x[(b // 2) * 32 + (b % 2) * 4 + (k // 4) * 8 + k % 4 + 1]), 'var_pop')) AS spread,
      list_transform(range(9), lambda b: list_aggregate(list_transform(range(16), lambda k: x[(b // 3) * 16 + (b % 3) * 2 + (k // 4) * 8 + k % 4 + 1]), 'var_pop')) AS tile_detail,
      list_transform(range(9), lambda b: list_concat(
        list_transform(range(12), lambda k: across[((b // 3) * 2 + k // 3) * 7 + (b % 3) * 2 + k % 3 + 1]),
        list_transform(range(12), lambda k: down[((b // 3) * 2 + k // 4) * 8 + (b % 3) * 2 + k % 4 + 1]))) AS tile_steps FROM r),
q AS (
  SELECT archive_id, pos, list_aggregate(bend, 'var_pop') AS sharpness,
    list_avg(list_concat(list_filter(across, lambda v, k: (k - 1) % 7 = 3), down[25:32])) / greatest(list_avg(list_concat(list_filter(across, lambda v, k: (k - 1) % 7 <> 3), down[1:24], down[33:56])), 1e-9) AS jpeg_blockiness,
    len(list_filter(range(36), lambda k: gradient[k + 1] > p90 AND turning[k + 1])) / greatest(len(list_filter(gradient, lambda g: g > p90)), 1) AS ringing,
    1 / greatest(list_avg(list_transform(across, lambda v: v * v)) + list_avg(list_transform(down, lambda v: v * v)), 1e-9) AS blur,
    list_avg(spread) AS detail,
    list_sum(list_transform(range(36), lambda k: CASE WHEN gradient[k + 1] <= p75 THEN abs(rest[k + 1]) ELSE 0 END)) / greatest(len(list_filter(gradient, lambda g: g <= p75)), 1) AS noise,
    tile_detail, tile_steps FROM t)
"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and tiles of 4 by 4, tiles two apart; a tile of one block has no border in it and a blockiness of nothing."""
    return grids.page_quality(_pages(spark, sf_dir), "grid", SHAPE, block=4, tile=4, step=2)


@query("WITH" + _STEPS + """
SELECT archive_id, pos, round(sharpness, 6) AS sharpness, round(jpeg_blockiness, 6) AS jpeg_blockiness, round(ringing, 6) AS ringing, round(blur, 6) AS blur,
       round(detail, 6) AS detail, round(noise, 6) AS noise, round(list_sum(tile_detail), 6) AS tiles, CAST(len(tile_detail) AS INTEGER) AS n_tiles FROM q""")
def f13_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir)
    total = F.aggregate("tile_detail", F.lit(0.0), lambda a, v: a + v)
    names = ("sharpness", "jpeg_blockiness", "ringing", "blur", "detail", "noise")
    return q.select("archive_id", "pos", *[F.round(n, 6).alias(n) for n in names], F.round(total, 6).alias("tiles"), F.size("tile_detail").alias("n_tiles"))


_DIRECTION = "CASE WHEN abs({l} - {r}) / greatest(abs({l}), abs({r}), 1e-9) <= 0.03 THEN 'TIE' WHEN {l} {op} {r} THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END"
_MEASURED = (("sharpness", ">"), ("jpeg_blockiness", "<"), ("ringing", "<"), ("blur", "<"), ("detail", ">"), ("noise", "<"))


@query("WITH" + _STEPS + f""",
means AS (SELECT l.archive_id AS a, r.archive_id AS b, {', '.join(f'avg(l.{n}) AS l_{n}, avg(r.{n}) AS r_{n}' for n, _ in _MEASURED)}
          FROM q l JOIN q r ON r.archive_id = l.archive_id + 1 AND r.pos = l.pos GROUP BY 1, 2),
d AS (SELECT a, b, list_filter(list_distinct([{', '.join(_DIRECTION.format(l=f'l_{n}', r=f'r_{n}', op=op) for n, op in _MEASURED)}]), lambda x: x <> 'TIE') AS d FROM means)
SELECT a, b, CASE WHEN len(d) = 0 THEN 'TIE' WHEN len(d) = 1 THEN d[1] ELSE 'UNKNOWN' END AS direction FROM d""")
def m12_measured_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring containers by the measured metrics of their pages."""
    q = materialize(_quality(spark, sf_dir), "quality")
    ids = q.select("archive_id").distinct()
    pairs = ids.select(F.col("archive_id").alias("a"), (F.col("archive_id") + 1).alias("b")).join(ids.toDF("b"), "b", "left_semi").select("a", "b")
    return ed.compare_quality(pairs, q)


_HASHES = _GRID + """
g AS (SELECT archive_id, pos, list_transform(x, lambda v: CAST(least(greatest(floor(v * 512 + 128), 0), 255) AS BIGINT)) AS x FROM e),
k AS (SELECT i, (i + 0.5) * 8 / 9 AS c FROM (SELECT unnest(range(9)) AS i)),
l AS (SELECT i, j, (j - c + 0.5) AS d FROM k, (SELECT unnest(range(8)) AS j) WHERE j >= greatest(0, CAST(trunc(c - 3 + 0.5) AS BIGINT)) AND j < least(8, CAST(trunc(c + 3 + 0.5) AS BIGINT))),
w AS (SELECT i, j, CASE WHEN abs(d) >= 3 THEN 0.0 WHEN d = 0 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w FROM l),
n AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) * 4194304 AS w FROM w),
f AS (SELECT i, j, CAST(CASE WHEN w < 0 THEN ceil(w - 0.5) ELSE floor(w + 0.5) END AS BIGINT) AS w FROM n),
u AS (SELECT archive_id, pos, y, i, least(greatest((sum(g.x[y * 8 + j + 1] * w) + 2097152) >> 22, 0), 255) AS v FROM g, (SELECT unnest(range(8)) AS y), f GROUP BY ALL),
h AS (SELECT archive_id, pos, list(v ORDER BY y, i) AS v FROM (SELECT archive_id, pos, y, i, CAST(v AS BIGINT) AS v FROM u) GROUP BY ALL),
b AS (SELECT h.archive_id, h.pos, list_transform(range(64), lambda k: CASE WHEN h.v[(k // 8) * 9 + k % 8 + 1] > h.v[(k // 8) * 9 + k % 8 + 2] THEN 1 ELSE 0 END) AS d,
             list_transform(range(64), lambda k: CASE WHEN g.x[k + 1] * 64 >= list_sum(g.x) THEN 1 ELSE 0 END) AS a FROM h JOIN g ON g.archive_id = h.archive_id AND g.pos = h.pos)
"""
_HEX = "array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + 8 * {c}[4 * k + 1] + 4 * {c}[4 * k + 2] + 2 * {c}[4 * k + 3] + {c}[4 * k + 4], 1)), '')"


@query("WITH" + _HASHES + f"SELECT archive_id, pos, {_HEX.format(c='d')} AS dhash, {_HEX.format(c='a')} AS ahash FROM b")
def f01_f03_grid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hashes of 8-bit grids; the nine columns of the difference hash come from resampling."""
    return grids.page_hashes(_grey(_pages(spark, sf_dir)), "grid", SHAPE)


@query("WITH" + _GRID + """
g AS (SELECT archive_id, pos, list_transform(x, lambda v: CAST(least(greatest(floor(v * 512 + 128), 0), 255) AS BIGINT)) AS x FROM e)
SELECT archive_id, pos, len(list_filter(range(21), lambda k: greatest(x[3 * k + 1], x[3 * k + 2], x[3 * k + 3]) - least(x[3 * k + 1], x[3 * k + 2], x[3 * k + 3]) >= 16)) / 21 AS score FROM g""")
def f12_grid_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 63 values as 21 pixels of three colours: a vector has one value more than colours fill."""
    pages = _grey(_pages(spark, sf_dir)).withColumn("grid", F.slice("grid", 1, 63))
    return grids.page_colour(pages, "grid", (3, 7))
