"""Pixel grids as row-major arrays of numbers: hashes, colour and quality of pages.

A grid is a column ``array<number>`` with its height and width; everything is measured in Arrow batches, all grids of one
shape at once, by slices of whole arrays. A grid that is null, is not of its shape, or holds a null or non-finite value has
null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Side of a block and of a tile, step of tiles, of pages of 512 by 512; share of a colourful page's pixels.
BLOCK, TILE, TILE_STEP = 8, 64, 32
COLOUR_RANGE = 16
METRICS = "sharpness double, jpeg_blockiness double, ringing double, blur double, detail double, noise double"
TILES = "tile_blockiness array<double>, tile_detail array<double>"
#: Values of grids that are measured at once.
AT_ONCE = 1 << 21


def _resize_weights(old: int, new: int) -> np.ndarray:
    """Matrix (new, old) of Lanczos weights of three lobes, in 22-bit integers as 8-bit images take them."""
    scale = old / new
    stretch = max(scale, 1.0)
    out = np.zeros((new, old), np.int64)
    for i in range(new):
        middle = (i + 0.5) * scale
        first, last = max(0, int(middle - 3 * stretch + 0.5)), min(old, int(middle + 3 * stretch + 0.5))
        x = (np.arange(first, last) - middle + 0.5) / stretch
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum() * (1 << 22)
        out[i, first:last] = np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5)).astype(np.int64)
    return out


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit grids ``(n, rows, columns)`` at another size: columns first, then rows, rounded to 8 bits after each."""
    out = images.astype(np.int64)
    for axis, size in ((2, width), (1, height)):
        if out.shape[axis] != size:
            sums = np.moveaxis(np.tensordot(out, _resize_weights(out.shape[axis], size), axes=([axis], [1])), -1, axis)
            out = np.clip((sums + (1 << 21)) >> 22, 0, 255)
    return out


def _hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits.reshape(len(bits), 64), axis=1)]


def difference_hashes(images: np.ndarray) -> list[str]:
    """64 bits: whether each of 9 by 8 pixels is lighter than the one to its right."""
    small = resized(images, 8, 9)
    return _hex(small[:, :, :-1] > small[:, :, 1:])


def mean_hashes(images: np.ndarray) -> list[str]:
    """64 bits: whether each of 8 by 8 pixels is as light as the mean or lighter."""
    small = resized(images, 8, 8)
    return _hex(small * 64 >= small.sum(axis=(1, 2), keepdims=True))


def _blockiness(across: np.ndarray, down: np.ndarray, block: int) -> np.ndarray:
    """Mean step between blocks over the mean step inside them, for each grid; NaN where there is no border."""
    n = len(across)
    edge_c, edge_r = (np.arange(k) % block == block - 1 for k in (across.shape[2], down.shape[1]))
    if not edge_c.any() and not edge_r.any():
        return np.full(n, np.nan)
    at, inside = ([x.reshape(n, -1) for x in pair] for pair in ((across[:, :, edge_c], down[:, edge_r]), (across[:, :, ~edge_c], down[:, ~edge_r])))
    return np.concatenate(at, 1).mean(1) / np.maximum(np.concatenate(inside, 1).mean(1), 1e-9)


def _block_variances(images: np.ndarray, block: int) -> np.ndarray:
    n, h, w = images.shape
    return images.reshape(n, h // block, block, w // block, block).var(axis=(2, 4)).reshape(n, -1).mean(1)


def quality(images: np.ndarray, block: int = BLOCK, tile: int = TILE, step: int = TILE_STEP) -> dict[str, np.ndarray]:
    """Metrics of grids ``(n, rows, columns)``; sides are multiples of ``block``, tiles lie ``step`` apart.

    ``sharpness`` is the variance of the Laplacian, ``blur`` one over the mean squared gradient, ``detail`` the mean variance
    of blocks, ``jpeg_blockiness`` steps at block borders over those inside. ``ringing`` is the share, among pixels with a
    gradient over the ninth decile, of those beside a change of sign of the residual from their neighbours' mean; ``noise``
    the mean residual where the gradient is up to the third quartile.
    """
    x = images.astype(float)
    n = len(x)
    across, down = np.abs(np.diff(x, axis=2)), np.abs(np.diff(x, axis=1))
    energy = (across**2).reshape(n, -1).mean(1) + (down**2).reshape(n, -1).mean(1)
    middle = x[:, 1:-1, 1:-1]
    around = x[:, 1:-1, :-2] + x[:, 1:-1, 2:] + x[:, :-2, 1:-1] + x[:, 2:, 1:-1]
    rest = middle - around / 4
    gradient = np.maximum(across[:, 1:-1, :-1], down[:, :-1, 1:-1])
    flat = gradient.reshape(n, -1)
    strong = gradient > np.percentile(flat, 90, axis=1)[:, None, None]
    quiet = gradient <= np.percentile(flat, 75, axis=1)[:, None, None]
    turns_c, turns_r = rest[:, :, 1:] * rest[:, :, :-1] < 0, rest[:, 1:] * rest[:, :-1] < 0
    turning = np.zeros_like(strong)
    turning[:, :, 1:] |= turns_c
    turning[:, :, :-1] |= turns_c
    turning[:, 1:] |= turns_r
    turning[:, :-1] |= turns_r
    out = {
        "sharpness": (around - 4 * middle).reshape(n, -1).var(1),
        "jpeg_blockiness": _blockiness(across, down, block),
        "ringing": (turning & strong).sum((1, 2)) / np.maximum(strong.sum((1, 2)), 1),
        "blur": 1 / np.maximum(energy, 1e-9),
        "detail": _block_variances(x, block),
        "noise": (np.abs(rest) * quiet).sum((1, 2)) / np.maximum(quiet.sum((1, 2)), 1),
    }
    tops = [(r, c) for r in range(0, x.shape[1] - tile + 1, step) for c in range(0, x.shape[2] - tile + 1, step)]
    tiles = [(x[:, r : r + tile, c : c + tile], across[:, r : r + tile, c : c + tile - 1], down[:, r : r + tile - 1, c : c + tile]) for r, c in tops]
    out["tile_blockiness"] = np.stack([_blockiness(a, d, block) for _, a, d in tiles], 1) if tops else np.empty((n, 0))
    out["tile_detail"] = np.stack([_block_variances(t, block) for t, _, _ in tiles], 1) if tops else np.empty((n, 0))
    return out


def _measured(pages: DataFrame, grid: str, shape: tuple[int, int], measure: Callable[[np.ndarray], dict], results: str, *keep: str) -> DataFrame:
    """``keep`` columns with the ``results`` of each grid, null for one that is none of ``shape``."""
    rows = pages.select(*keep, pages[grid].cast("array<double>").alias("_grid"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    size = shape[0] * shape[1]
    step = max(1, AT_ONCE // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                good = [g is not None and len(g) == size and bool(np.isfinite(np.array(g, float)).all()) for g in part["_grid"]]
                out = part[list(keep)].copy()
                found = measure(np.stack([np.array(g, float) for g, ok in zip(part["_grid"], good) if ok]).reshape(-1, *shape)) if any(good) else {}
                for name in (r.strip().split()[0] for r in results.split(", ")):
                    column = pd.Series([None] * len(part), dtype=object)
                    values = found.get(name, [])
                    for i, v in zip(np.flatnonzero(good), values if isinstance(values, list) else values.tolist()):
                        column.iat[i] = v
                    out[name] = column.to_numpy()
                yield out

    return rows.mapInPandas(run, f"{kept}, {results}")


def page_quality(pages: DataFrame, grid: str, shape: tuple[int, int] = (512, 512), keep: tuple[str, ...] = ("archive_id", "pos"), block: int = BLOCK, tile: int = TILE, step: int = TILE_STEP) -> DataFrame:
    """``(*keep, sharpness, jpeg_blockiness, ringing, blur, detail, noise, tile_blockiness, tile_detail)`` of each page's grid."""
    return _measured(pages, grid, shape, lambda x: quality(x, block, tile, step), f"{METRICS}, {TILES}", *keep)


def page_hashes(pages: DataFrame, grid: str, shape: tuple[int, int], keep: tuple[str, ...] = ("archive_id", "pos")) -> DataFrame:
    """``(*keep, dhash, ahash)`` of each page's grid of 8-bit grey values, as 16 hex digits; values are cut to 0 to 255."""

    def measure(images: np.ndarray) -> dict:
        grey = np.clip(images, 0, 255).astype(np.int64)
        return {"dhash": difference_hashes(grey), "ahash": mean_hashes(grey)}

    return _measured(pages, grid, shape, measure, "dhash string, ahash string", *keep)


def page_colour(pages: DataFrame, grid: str, shape: tuple[int, int], keep: tuple[str, ...] = ("archive_id", "pos")) -> DataFrame:
    """``(*keep, score)``: the share of pixels whose three colours lie ``COLOUR_RANGE`` or more apart.

    ``grid`` holds red, green and blue of each pixel in turn; ``shape`` is that of the pixels.
    """

    def measure(images: np.ndarray) -> dict:
        pixels = images.reshape(len(images), -1, 3)
        return {"score": (pixels.max(2) - pixels.min(2) >= COLOUR_RANGE).mean(1)}

    return _measured(pages, grid, (shape[0], shape[1] * 3), measure, "score double", *keep)
