"""Hashes, colour and quality of pixel grids against pixel-by-pixel versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomatch.functions import grids
from foliomatch.operators import editions as ed


def lanczos(x):
    if abs(x) >= 3:
        return 0.0
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def resize_line(line, new):
    scale = len(line) / new
    stretch = max(1.0, scale)
    out = []
    for i in range(new):
        c = (i + 0.5) * scale
        lo, hi = max(0, int(c - 3 * stretch + 0.5)), min(len(line), int(c + 3 * stretch + 0.5))
        w = [lanczos((j - c + 0.5) / stretch) for j in range(lo, hi)]
        fixed = [int(x / sum(w) * (1 << 22) + (0.5 if x >= 0 else -0.5)) for x in w]
        out.append(min(255, max(0, (sum(a * b for a, b in zip(fixed, line[lo:hi])) + (1 << 21)) >> 22)))
    return out


def resize(rows, height, width):
    if len(rows[0]) != width:
        rows = [resize_line(r, width) for r in rows]
    if len(rows) != height:
        rows = [list(r) for r in zip(*[resize_line(list(c), height) for c in zip(*rows)])]
    return rows


@pytest.mark.parametrize("shape", [(8, 8), (9, 8), (8, 9), (20, 31), (64, 17), (3, 5), (1, 1)])
def test_hashes(shape):
    r = random.Random(sum(shape))
    images = [[[r.randrange(256) for _ in range(shape[1])] for _ in range(shape[0])] for _ in range(4)] + [[[7] * shape[1]] * shape[0]]
    stack = np.array(images)
    for image, d, a in zip(images, grids.difference_hashes(stack), grids.mean_hashes(stack)):
        small = resize(image, 8, 9)
        assert d == f"{int(''.join(str(int(row[k] > row[k + 1])) for row in small for k in range(8)), 2):016x}"
        flat = [v for row in resize(image, 8, 8) for v in row]
        assert a == f"{int(''.join(str(int(v >= sum(flat) / 64)) for v in flat), 2):016x}"


def plain_quality(x, block, tile, step):
    n, m = len(x), len(x[0])
    across = {(r, c): abs(x[r][c + 1] - x[r][c]) for r in range(n) for c in range(m - 1)}
    down = {(r, c): abs(x[r + 1][c] - x[r][c]) for r in range(n - 1) for c in range(m)}
    mean = lambda v: sum(v) / len(v)
    var = lambda v: mean([(y - mean(v)) ** 2 for y in v])

    def blocky(top, left, size_r, size_c):
        at, inside = [], []
        for r in range(size_r):
            for c in range(size_c - 1):
                (at if c % block == block - 1 else inside).append(across[top + r, left + c])
        for r in range(size_r - 1):
            for c in range(size_c):
                (at if r % block == block - 1 else inside).append(down[top + r, left + c])
        return mean(at) / max(mean(inside), 1e-9)

    def detail(top, left, size_r, size_c):
        return mean([var([x[top + a + i][left + b + j] for i in range(block) for j in range(block)]) for a in range(0, size_r, block) for b in range(0, size_c, block)])

    inner = [(r, c) for r in range(1, n - 1) for c in range(1, m - 1)]
    around = {(r, c): x[r][c - 1] + x[r][c + 1] + x[r - 1][c] + x[r + 1][c] for r, c in inner}
    rest = {p: x[p[0]][p[1]] - around[p] / 4 for p in inner}
    gradient = {(r, c): max(across[r, c - 1], down[r - 1, c]) for r, c in inner}
    p90, p75 = (np.percentile(list(gradient.values()), q) for q in (90, 75))
    strong, quiet = [p for p in inner if gradient[p] > p90], [p for p in inner if gradient[p] <= p75]
    turns = [any((q in rest) and rest[q] * rest[r, c] < 0 for q in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c))) for r, c in strong]
    tops = [(r, c) for r in range(0, n - tile + 1, step) for c in range(0, m - tile + 1, step)]
    return {
        "sharpness": var([around[p] - 4 * x[p[0]][p[1]] for p in inner]), "jpeg_blockiness": blocky(0, 0, n, m), "ringing": mean(turns) if turns else 0.0,
        "blur": 1 / max(mean([v * v for v in across.values()]) + mean([v * v for v in down.values()]), 1e-9), "detail": detail(0, 0, n, m),
        "noise": mean([abs(rest[p]) for p in quiet]) if quiet else 0.0,
        "tile_blockiness": [blocky(r, c, tile, tile) for r, c in tops], "tile_detail": [detail(r, c, tile, tile) for r, c in tops],
    }


def test_quality(spark):
    r = random.Random(2)
    pages = [[[r.uniform(0, 255) for _ in range(24)] for _ in range(16)] for _ in range(3)] + [[[9.0] * 24] * 16, [[float(c // 8 * 40 + k // 8) for c in range(24)] for k in range(16)]]
    flat = [(i, 0, [v for row in p for v in row]) for i, p in enumerate(pages)]
    odd = [(50, 0, None), (51, 0, [1.0]), (52, 0, [float("nan")] * 384), (53, 0, [None] * 384), (54, 0, [])]
    df = spark.createDataFrame(flat + odd, "archive_id long, pos int, grid array<double>")
    got = {x.archive_id: x for x in grids.page_quality(df, "grid", (16, 24), block=8, tile=16, step=8).collect()}
    assert len(got) == len(flat) + len(odd)
    for i, p in enumerate(pages):
        want = plain_quality(p, 8, 16, 8)
        for name, value in want.items():
            assert got[i][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
    assert all(got[i].sharpness is None and got[i].tile_detail is None for i in range(50, 55))
    assert grids.page_quality(df.limit(0), "grid", (16, 24), block=8, tile=16, step=8).collect() == []


def test_whole_pages_have_225_tiles():
    page = np.random.default_rng(0).uniform(0, 255, (1, 512, 512))
    out = grids.quality(page)
    assert out["tile_detail"].shape == (1, 225)
    one = grids.quality(page[:, 64:128, 32:96], tile=64, step=32)
    assert out["tile_blockiness"][0, 2 * 15 + 1] == pytest.approx(one["jpeg_blockiness"][0]) and out["tile_detail"][0, 2 * 15 + 1] == pytest.approx(one["detail"][0])


def test_measured_pages_decide(spark):
    """Pages and their mosaics: sharp pages win by all metrics' means or leave it open, and by their tiles."""
    r = np.random.default_rng(3)
    rows = []
    for pos in range(4):
        sharp = np.kron(r.uniform(0, 255, (64, 64)), np.ones((2, 2))) + r.uniform(0, 40, (128, 128))
        mosaic = np.kron(sharp.reshape(16, 8, 16, 8).mean((1, 3)), np.ones((8, 8)))
        rows += [(1, pos, sharp.ravel().tolist()), (2, pos, mosaic.ravel().tolist()), (3, pos, sharp.ravel().tolist())]
    df = spark.createDataFrame(rows, "archive_id long, pos int, grid array<double>")
    q = grids.page_quality(df, "grid", (128, 128), block=8, tile=64, step=32)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 9)], "a long, b long")
    got = {(x.a, x.b): x.direction for x in ed.compare_mosaic(pairs, q).collect()}
    assert got == {(1, 2): "LEFT_BETTER", (2, 3): "RIGHT_BETTER", (1, 3): "UNKNOWN", (1, 9): "UNKNOWN"}
    means = {(x.a, x.b): x.direction for x in ed.compare_quality(pairs, q).collect()}
    assert means[1, 3] == "TIE" and means[1, 9] == "UNKNOWN"


def test_colour(spark):
    rows = [(1, 0, [0, 15, 0, 9, 9, 25]), (2, 0, [0, 0, 0, 200, 201, 202]), (3, 0, None), (4, 0, [1, 2])]
    df = spark.createDataFrame(rows, "archive_id long, pos int, grid array<int>")
    assert {x.archive_id: x.score for x in grids.page_colour(df, "grid", (1, 2)).collect()} == {1: 0.5, 2: 0.0, 3: None, 4: None}


def test_hashes_as_a_table(spark):
    df = spark.range(3).select(F.col("id").alias("archive_id"), F.lit(0).alias("pos"), F.when(F.col("id") < 2, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k * 4).cast("double"))).alias("grid"))
    got = grids.page_hashes(df, "grid", (8, 8)).collect()
    assert [(x.dhash, x.ahash) for x in got] == [("0" * 16, "00000000ffffffff")] * 2 + [(None, None)]
