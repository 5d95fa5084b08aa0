"""Hash, sampling and comparison expressions. Hashes are 16 hexadecimal digits or the same bits as a signed long."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.functions.text import let
from foliomatch.functions.udfs import deferred

# Fixed values of the 64-bit band layout: widths and offsets, most significant band first.
BAND_WIDTHS = (10, 9, 9, 9, 9, 9, 9)
BAND_OFFSETS = (54, 45, 36, 27, 18, 9, 0)
# Fixed value: greatest number of differing bits between two hashes of matching units.
MAX_HASH_DISTANCE = 6
# Shares of the way from the first to the last unit that are probed.
PROBE_SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def is_hash64(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def hash_to_long(value: Column) -> Column:
    """Signed long with the bits of 16 hex digits; null for anything else. ANSI conversion of all 64 bits would throw."""
    ok = F.when(is_hash64(value), value)
    high = F.conv(F.substring(ok, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(ok, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(left.bitwiseXOR(right))


def band(value: Column, index: int) -> Column:
    mask = (1 << BAND_WIDTHS[index]) - 1
    return F.shiftrightunsigned(value, BAND_OFFSETS[index]).bitwiseAND(F.lit(mask))


def bands(value: Column) -> Column:
    """All bands as an array of (band, key); two hashes within ``MAX_HASH_DISTANCE`` bits share one at least."""
    return F.array(*[F.struct(F.lit(i).alias("band"), band(value, i).alias("key")) for i in range(len(BAND_WIDTHS))])


def probe_slots(n: Column) -> Column:
    """Array of (slot, pos) of the probed positions of n units: slots number the distinct positions in order."""
    last = F.greatest(n - 1, F.lit(0))
    positions = F.array_distinct(F.transform(F.array(*[F.lit(s) for s in PROBE_SHARES]), lambda s: F.bround(last * s).cast("int")))
    return F.when(n > 0, F.transform(positions, lambda p, i: F.struct(i.alias("slot"), p.alias("pos")))).otherwise(F.array().cast("array<struct<slot:int,pos:int>>"))


def even_sample(n: Column, limit: int = 12) -> Column:
    """At most ``limit`` positions of n, evenly spread with both ends."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(limit - 1)).cast("int")))
    whole = F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= limit, whole).otherwise(spread)


def interior_positions(n: int, limit: int) -> list[int]:
    """Up to ``limit`` positions, the middle first, then always the one farthest from those chosen; nested in ``limit``.

    The two ends are left out of five or more. Ties go to the one nearer the middle, then to the smaller.
    """
    pool = list(range(1, n - 1)) if n >= 5 else list(range(max(n, 0)))
    if not pool or limit <= 0:
        return []
    if limit >= len(pool):
        return pool
    middle = (pool[0] + pool[-1]) / 2
    gap = {p: float("inf") for p in pool}
    chosen: list[int] = []
    while len(chosen) < limit:
        p = max(gap, key=lambda x: (gap[x], -abs(x - middle), -x))
        chosen.append(p)
        del gap[p]
        for x in gap:
            gap[x] = min(gap[x], abs(x - p))
    return sorted(chosen)


@deferred("array<int>")
def interior_sample(n: pd.Series, limit: pd.Series) -> pd.Series:
    """``interior_positions`` over columns; equal arguments are worked out once per batch."""
    known: dict[tuple[int, int], list[int]] = {}
    out = []
    for key in zip(n.fillna(0).astype(int), limit.fillna(0).astype(int)):
        if key not in known:
            known[key] = interior_positions(*key)
        out.append(known[key])
    return pd.Series(out)


# Fixed values of the stable 64-bit pair rank: one odd multiplier for each input, two for the mixer.
RANK_FACTORS = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)
RANK_MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _times(df: DataFrame, column: str, factor: int) -> DataFrame:
    """``column`` times an unsigned constant modulo 2^64. Limbs of 22 bits keep every product and sum within a long, as
    ANSI arithmetic must not overflow; each step is a projection of its own, so no expression is worked out twice."""
    low = (1 << 22) - 1
    f = [factor & low, factor >> 22 & low, factor >> 44]
    c = F.col(column)
    limbs = df.withColumns({"_x0": c.bitwiseAND(F.lit(low)), "_x1": F.shiftrightunsigned(c, 22).bitwiseAND(F.lit(low)), "_x2": F.shiftrightunsigned(c, 44)})
    x = [F.col(f"_x{i}") for i in range(3)]
    sums = limbs.withColumns({"_p0": x[0] * f[0], "_p1": x[0] * f[1] + x[1] * f[0], "_p2": x[0] * f[2] + x[1] * f[1] + x[2] * f[0]})
    carried = sums.withColumn("_p1", F.col("_p1") + F.shiftrightunsigned("_p0", 22))
    high = F.shiftleft(F.col("_p2") + F.shiftrightunsigned("_p1", 22), 44)
    whole = high.bitwiseOR(F.shiftleft(F.col("_p1").bitwiseAND(F.lit(low)), 22)).bitwiseOR(F.col("_p0").bitwiseAND(F.lit(low)))
    return carried.withColumn(column, whole).drop("_x0", "_x1", "_x2", "_p0", "_p1", "_p2")


def with_pair_rank(pairs: DataFrame, root: int = 1, version: int = 2, name: str = "_rank") -> DataFrame:
    """``pairs(a, b, ...)`` with a pseudo-random rank, the same on every run; signed order is the unsigned order of the bits."""
    mask = (1 << 64) - 1
    start = (root * RANK_FACTORS[0] & mask) ^ (version * RANK_FACTORS[1] & mask)
    df = pairs.withColumns({"_ra": F.col("a").cast("long"), "_rb": F.col("b").cast("long")})
    df = _times(_times(df, "_ra", RANK_FACTORS[2]), "_rb", RANK_FACTORS[3])
    signed = start - (1 << 64) if start >> 63 else start
    df = df.withColumn(name, F.lit(signed).cast("long").bitwiseXOR(F.col("_ra")).bitwiseXOR(F.col("_rb"))).drop("_ra", "_rb")
    for shift, factor in zip((30, 27), RANK_MIXERS):
        df = _times(df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, shift))), name, factor)
    last = F.col(name).bitwiseXOR(F.shiftrightunsigned(name, 31))
    return df.withColumn(name, last.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def relative_direction(left: Column, right: Column, lower_is_better: bool = False, dead_band: float = 0.03) -> Column:
    """TIE within the dead band of the larger magnitude, else the better side."""
    scale = F.greatest(F.abs(left), F.abs(right), F.lit(1e-9))
    better = left < right if lower_is_better else left > right
    return F.when(F.abs(left - right) / scale <= dead_band, "TIE").when(better, "LEFT_BETTER").otherwise("RIGHT_BETTER")


def group_key(root: Column, ids: Column) -> Column:
    """SHA-256 of "root:id,id,..." over sorted ids."""
    return F.sha2(F.concat(root.cast("string"), F.lit(":"), F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")), 256)


# Fixed value: version of the rule that makes candidate sets, part of their keys.
SET_VERSION = "v2"


def set_key(group: Column, kind: Column, ids: Column, version: str = SET_VERSION) -> Column:
    """SHA-256 of "group|kind|[id, id, ...]|version" over sorted ids."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ", "), F.lit("]"))
    return F.sha2(F.concat_ws("|", group.cast("string"), kind, listed, F.lit(version)), 256)


def listing_signature(members: Column) -> Column:
    """SHA-256 over members ``struct<pos, path, size, packed, crc, kind>`` in order of position.

    Key of the path, both sizes, CRC in lower case and kind of every member, all joined by NUL; what is unknown is empty.
    ``path`` is to be an ``entry_key``.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda m: F.concat_ws("\0", text(m["path"]), text(m["size"]), text(m["packed"]), F.lower(text(m["crc"])), text(m["kind"]))
    return F.sha2(F.array_join(F.transform(F.array_sort(members), one), "\0"), 256)


def sign_hash(vector: Column) -> Column:
    """16 hex digits of the signs of the first 64 components, most significant first: 1 where above 0."""
    def nibble(i: int) -> Column:
        bit = lambda j: F.when(F.coalesce(F.try_element_at(vector, F.lit(4 * i + j + 1)), F.lit(0.0)) > 0, 1 << (3 - j)).otherwise(0)
        return F.lower(F.hex(bit(0) + bit(1) + bit(2) + bit(3)))

    return F.concat(*[nibble(i) for i in range(16)])


def slice_hashes(text: Column) -> Column:
    """Struct (dhash, ahash), each of 16 hex digits: the first and the second of the MD5 of each sixteenth of a text's words.

    A word that is replaced moves at most four bits of either. Words are cut once and every slice is hashed once.
    """
    def digests(w: Column) -> Column:
        cut = lambda k: F.floor(k * F.size(w) / F.lit(16)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.md5(F.array_join(F.slice(w, cut(k) + 1, cut(k + 1) - cut(k)), " ").cast("binary")))

    def digits(m: Column) -> Column:
        one = lambda i: F.array_join(F.transform(m, lambda d: F.substring(d, i, 1)), "")
        return F.struct(one(1).alias("dhash"), one(2).alias("ahash"))

    return let(let(F.split(text, " "), digests), digits)
