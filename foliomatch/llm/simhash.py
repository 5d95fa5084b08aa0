"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.common import map_batches
from foliomatch.operators.graph import connected_components
from foliomatch.plans.stages import materialize, shuffle_partitions

SHINGLE_WORDS, MAX_BITS = 4, 4
#: A list longer than this is compared in tiles of so many fingerprints, each tile by a task.
TILE = 4096
#: Groups up to this size are compared all at once with those of a batch; larger ones by a matrix of their own.
SMALL = 12


def position_sets(max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Sets of three byte positions such that any ``8 - max_bits`` of the eight hold one of them.

    Two fingerprints with at most ``max_bits`` differing bits agree in at least ``8 - max_bits`` bytes, so they meet in
    a list of one of these sets. For four bits the positions fall into three classes in a ring, and the sets are those
    within a class and those of two of a class and one of the next: 20, the fewest there are (Turan). Else they are
    chosen greedily.
    """
    need = {frozenset(c) for c in combinations(range(8), 8 - max_bits)}
    sets = [frozenset(c) for c in combinations(range(8), min(3, 8 - max_bits))]
    if max_bits == 4:
        rings = {(0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
        sets = [s for s in sets if tuple(sorted(x % 3 for x in s)) in rings]
    chosen = []
    while need:
        best = max(sets, key=lambda s: (sum(s <= n for n in need), sorted(s, reverse=True)))
        chosen.append(tuple(sorted(best)))
        need = {n for n in need if not best <= n}
    return chosen


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: see ``fingerprints``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, and only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp long)``: the SimHash of every whole text, its 64 bits as a signed long.

    ASCII letters are folded, words are runs without ASCII white space, shingles are ``shingle`` words with repeats and hash by
    XXH64 (seed 42). A bit is set if it is set in over half the shingles. Fewer words make one shingle, none (also a
    null text) give 0. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, fp long")


def _linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """For differences ``x`` (xor): enough equal positional bytes first, then the bits themselves."""
    enough = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1, dtype=np.int8) >= 8 - max_bits
    enough[enough] = np.bitwise_count(x[enough]) <= max_bits
    return enough


def _forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links among ``left``, or between ``left`` and ``right``, connect: no more than nodes."""
    other = left if right is None else right
    link = np.concatenate([_linked(left[i : i + 64, None] ^ other[None, :], max_bits) for i in range(0, len(left), 64)])
    mine, yours = np.arange(len(left)), np.arange(len(other)) + (0 if right is None else len(left))
    while True:
        a = np.minimum(mine, np.where(link, yours[None, :], 1 << 30).min(1))
        b = np.minimum(yours, np.where(link, a[:, None], 1 << 30).min(0))
        if right is None:
            a = b = np.minimum(a, b)
        if (a == mine).all() and (b == yours).all():
            break
        mine, yours = a, b
    nodes = left if right is None else np.concatenate([left, right])
    labels = mine if right is None else np.concatenate([mine, yours])
    moved = labels != np.arange(len(nodes))
    return nodes[moved], nodes[labels[moved]]


def _pairs_of_lists(batches: Iterator[pa.RecordBatch], max_bits: int, tile: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by list: edges ``(a, b, null)``; the members of lists over ``tile`` as ``(fp, null, list)``."""
    names = ["a", "b", "list"]

    def edges(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names)

    def whole(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        group = np.repeat(np.arange(len(size)), size)
        keep = (size[group] > 1) & (size[group] <= SMALL)
        k, f = key[keep], fp[keep]
        for step in range(1, SMALL):
            if step >= len(k):
                break
            at = np.flatnonzero(k[step:] == k[:-step])
            if not len(at):
                break
            at = at[_linked((f[at + step] ^ f[at]).view(np.uint64), max_bits)]
            if len(at):
                yield edges(f[at], f[at + step])
        for g in np.flatnonzero(size > SMALL):
            mine = fp[start[g] : start[g] + size[g]]
            if len(mine) > tile:
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.nulls(len(mine), pa.int64()), pa.array(np.full(len(mine), key[start[g]]))], names)
            else:
                a, b = _forest(mine.view(np.uint64), None, max_bits)
                yield edges(a.view(np.int64), b.view(np.int64))

    key, fp, flowing = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy()])
        last = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
        if flowing is not None and (mine := key == flowing).any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[mine]), pa.nulls(int(mine.sum()), pa.int64()), pa.array(key[mine])], names)
            key, fp = key[~mine], fp[~mine]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield from whole(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
        if len(key) > tile:  # pass a long list on as it comes
            flowing = key[0]
            yield from whole(key, fp)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from whole(key, fp)


def near_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps(fp)`` that join exactly what links of at most ``max_bits`` join.

    A fingerprint is posted in a list for every set of ``position_sets`` under its bytes there. In a list each pair's
    equal positional bytes are tallied, pairs with fewer than ``8 - max_bits`` go, the rest is verified by counting bits.
    Small lists give their links; a long list gives a forest over its members, never all pairs. The members of a list
    over ``tile`` are dealt out in tiles by a second shuffle, so that no task compares an unbounded list.
    """
    spark = fps.sparkSession
    parts = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    lists = [
        sum((parts[p] * F.lit(256**j) for j, p in enumerate(s)), F.lit(n << 24).cast("long"))
        for n, s in enumerate(position_sets(max_bits))
    ]
    posted = fps.select(F.explode(F.array(*lists)).alias("list"), "fp")
    dealt = posted.repartition(shuffle_partitions(spark), "list").sortWithinPartitions("list")
    found = materialize(dealt.mapInArrow(lambda it: _pairs_of_lists(it, max_bits, tile), "a long, b long, list long"), "simhash")
    edges, long = found.where("list IS NULL").select("a", "b"), found.where("list IS NOT NULL").select("list", F.col("a").alias("fp"))
    if long.isEmpty():
        return edges

    sizes = long.groupBy("list").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    mine = long.join(sizes, "list").withColumn("c", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    tiles = mine.select("list", "fp", "c", others).select("list", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("right"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        fp, right = table.column("fp").to_numpy().view(np.uint64), table.column("right").to_numpy()
        a, b = _forest(fp, None, max_bits) if i == j else _forest(fp[~right], fp[right], max_bits) if right.any() and not right.all() else (fp[:0], fp[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return edges.unionByName(tiles.groupBy("list", "i", "j").applyInArrow(compare, "a long, b long"))


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Documents link where their fingerprints differ in at most ``max_bits`` bits; equal ones meet at once, so copies of a
    text cost one posting. ``component_id`` is the smallest doc_id reachable (null ids do not count; null if there is
    no other). Repeated rows get the same result each; an empty table gives none.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = connected_components(near_fingerprints(distinct.select("fp"), max_bits))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
