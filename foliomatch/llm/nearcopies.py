"""Near copies by similarity of word shingles: long SimHash fingerprints find them, the shingles themselves decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.llm.common import map_batches
from foliomatch.llm.simhash import SMALL
from foliomatch.operators.graph import connected_components
from foliomatch.plans.stages import materialize, shuffle_partitions

#: Shingles are so many words; documents that share so much of them are near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A fingerprint has so many bytes. At a similarity of 0.8 a bit differs with 0.152, a byte is equal with 0.269.
BYTES = 64
#: Lists are kept for each pair of byte positions of a class of so many: 63 lists, of which near copies miss all with 0.016 at 0.8.
CLASS = 3
#: Of the first 192 bits so many may differ: 29 are expected at 0.8, with a deviation of 5.
WORDS, MAX_BITS = 3, 45
#: A longer list is compared in tiles, and a larger candidate group verified in tiles after a look at its pivots.
TILE, TOGETHER, PIVOTS = 2048, 1024, 4
#: Tasks over which the members of one large group meet its pivots.
SALTS = 64

PAIRS = [p for at in range(0, BYTES - CLASS + 1, CLASS) for p in combinations(range(at, at + CLASS), 2)]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending; words as in ``simhash.fingerprints``, fewer make one, none give none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    line, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BYTES`` bytes: a bit is set if it is set in over half of the shingles, each spread over all bits by a mixer."""
    count = np.zeros(8 * BYTES, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 255):  # so that sums fit into a byte
            x = hashes[at : at + 255, None] + np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            count += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little")


def _key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, _key long, sig long, fp binary)``: ``_key`` tells texts of one doc_id apart, ``sig`` sets of shingles."""
    from xxhash import xxh3_64_intdigest

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs, fps = [], []
        for text in batch.column(2).to_pylist():
            h = shingles(text, words)
            sigs.append(xxh3_64_intdigest(h.tobytes()))
            fps.append(fingerprint(h).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(fps, pa.binary())], ["doc_id", "_key", "sig", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("_key"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, "doc_id long, _key long, sig long, fp binary")


def _post(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The lists in which each fingerprint stands, with the bits that are compared there."""
    n = batch.num_rows
    fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, BYTES)
    key = np.stack([(np.int64(k) << 16) | (fp[:, i].astype(np.int64) << 8) | fp[:, j] for k, (i, j) in enumerate(PAIRS)], 1).ravel()
    bits = np.repeat(np.ascontiguousarray(fp[:, : 8 * WORDS]).view(np.int64), len(PAIRS), 0)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), len(PAIRS))), *(pa.array(bits[:, i]) for i in range(WORDS))], ["list", "sig", *(f"f{i}" for i in range(WORDS))])


def _near(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int16) <= MAX_BITS


def _forest(sig: np.ndarray, f: np.ndarray, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what close bits connect among all, or between the first ``left`` and the rest; no more than nodes."""
    a, b = (f, f) if left is None else (f[:left], f[left:])
    link = np.concatenate([_near(a[i : i + 64, None] ^ b[None]) for i in range(0, len(a), 64)])
    mine, yours = np.arange(len(a)), np.arange(len(b)) + (left or 0)
    while True:
        p = np.minimum(mine, np.where(link, yours[None, :], 1 << 30).min(1))
        q = np.minimum(yours, np.where(link, p[:, None], 1 << 30).min(0))
        if left is None:
            p = q = np.minimum(p, q)
        if (p == mine).all() and (q == yours).all():
            break
        mine, yours = p, q
    labels = mine if left is None else np.concatenate([mine, yours])
    moved = labels != np.arange(len(sig))
    return sig[moved], sig[labels[moved]]


def _of_lists(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by list: edges ``(a, b, null)``; members of lists over ``tile`` as ``(sig, null, list)``."""

    def rows(a, b, key) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(key, pa.int64())], ["a", "b", "list"])

    def whole(key, sig, f):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        keep = np.repeat((size > 1) & (size <= SMALL), size)
        k, s, g = key[keep], sig[keep], f[keep]
        for step in range(1, SMALL):
            at = np.flatnonzero(k[step:] == k[:-step])
            if not len(at):
                break
            at = at[_near(g[at + step] ^ g[at])]
            if len(at):
                yield rows(s[at], s[at + step], None)
        for n in np.flatnonzero(size > SMALL):
            here = slice(start[n], start[n] + size[n])
            if size[n] > tile:
                yield rows(sig[here], None, key[here])
            else:
                a, b = _forest(sig[here], f[here])
                if len(a):
                    yield rows(a, b, None)

    key, sig, f, flowing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WORDS), np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        key, sig, f = np.concatenate([key, columns[0]]), np.concatenate([sig, columns[1]]), np.concatenate([f, np.stack(columns[2:], 1)])
        if flowing is not None and (n := int(np.searchsorted(key, flowing, "right"))):
            yield rows(sig[:n], None, key[:n])
            key, sig, f = key[n:], sig[n:], f[n:]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
        if last:
            yield from whole(key[:last], sig[:last], f[:last])
            key, sig, f = key[last:], sig[last:], f[last:]
        if len(key) > tile:
            flowing = key[0]
            yield rows(sig, None, key)
            key, sig, f = key[:0], sig[:0], f[:0]
    if len(key):
        yield from whole(key, sig, f)


def candidate_edges(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that join what close fingerprints of ``distinct(sig, fp)`` join; a long list gives a forest by tiles."""
    spark = distinct.sparkSession
    bits = [f"f{i}" for i in range(WORDS)]
    posted = map_batches(distinct.select("sig", "fp"), _post, "list long, sig long, " + ", ".join(f"{b} long" for b in bits))
    dealt = posted.repartition(shuffle_partitions(spark), "list").sortWithinPartitions("list")
    found = materialize(dealt.mapInArrow(lambda it: _of_lists(it, tile), "a long, b long, list long"), "near-copies")
    edges, long = found.where("list IS NULL").select("a", "b"), found.where("list IS NOT NULL").select("list", F.col("a").alias("sig"))
    if long.isEmpty():
        return edges
    sizes = long.groupBy("list").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    mine = long.join(sizes, "list").withColumn("c", F.pmod(F.xxhash64("sig"), "n").cast("int")).join(distinct.select("sig", "fp"), "sig")
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    tiles = mine.select("list", "sig", "fp", "c", others).select("list", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("right"), "sig", "fp")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("right")
        right = int(np.count_nonzero(t.column("right").to_numpy()))
        sig = t.column("sig").to_numpy()
        f = np.ascontiguousarray(np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(sig), BYTES)[:, : 8 * WORDS]).view(np.int64)
        if t.column("i")[0] == t.column("j")[0]:
            a, b = _forest(sig, f)
        else:
            a, b = _forest(sig, f, len(sig) - right) if 0 < right < len(sig) else (sig[:0], sig[:0])
        return pa.table({"a": a, "b": b})

    return edges.unionByName(tiles.groupBy("list", "i", "j").applyInArrow(compare, "a long, b long"))


def similar(sets: list[np.ndarray], x: np.ndarray, least: float) -> np.ndarray:
    """For ``sets`` of distinct hashes: which of them have a similarity of at least ``least`` to ``x``."""
    sizes = np.array([len(s) for s in sets])
    at = np.minimum(np.searchsorted(x, pool := np.concatenate(sets)), len(x) - 1)
    both = np.add.reduceat(x[at] == pool, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= least * (sizes + len(x) - both) - 1e-9


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows ``(component, i, j, right, sig, grp, shingles)`` sorted by tile: edges that join what similar pairs join."""

    def flat():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for (_, i, j), members in groupby(flat(), lambda r: r[:3]):
        members = list(members)
        sets = [np.frombuffer(r[6], np.uint64) for r in members]
        right, sig = np.array([r[3] for r in members]), np.array([r[4] for r in members], np.int64)
        labels = np.unique(np.array([r[5] for r in members]), return_inverse=True)[1]
        rows = range(len(sets))
        if i != j:
            rows = np.flatnonzero(right if right.sum() * 2 <= len(right) else ~right).tolist()
        edges = []
        for n in rows:
            # only members that nothing joins yet, of the other side in a tile of two
            open_ = labels != labels[n]
            open_ &= (right != right[n]) if i != j else (np.arange(len(sets)) > n)
            at = np.flatnonzero(open_)
            if len(at):
                at = at[similar([sets[k] for k in at], sets[n], least)]
                for k in at[np.unique(labels[at], return_index=True)[1]]:
                    edges.append((sig[n], sig[k]))
                labels[np.isin(labels, labels[at])] = labels[n]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])


def near_copies(docs: DataFrame, least: float = SIMILARITY, words: int = SHINGLE_WORDS, tile: int = TILE, together: int = TOGETHER) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Documents link where the Jaccard similarity of their sets of shingles is at least ``least``; texts without a word
    are copies of each other. ``component_id`` is the smallest doc_id reachable (null ids do not count). Candidates are
    components of close fingerprints, so a pair of exactly 0.8 is missed with about 0.02 and others less. All members of
    a candidate component are then compared by their shingles. One over ``together`` is compared with a few of its
    members first, and then in tiles, save those of which all members are joined already.
    """
    n = shuffle_partitions(docs.sparkSession)
    prints = materialize(_prints(docs, words), "prints")
    distinct = materialize(prints.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "distinct-prints")
    worded = distinct.where(F.col("fp") != F.lit(bytes(BYTES)))
    groups = connected_components(candidate_edges(worded, tile)).withColumnRenamed("node", "sig")

    def with_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["component", "sig", "shingles"])

    # one text, that of the least doc_id, for each member of a candidate group
    none = F.lit(-(1 << 63)).cast("long")
    one = prints.join(groups, "sig").groupBy("component", "sig").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("_id"), "_key")).alias("at"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), _key(docs).alias("_key"), F.col("text").cast("string").alias("text"))
    read = texts.join(one.select("component", "sig", "at.*"), ["_id", "_key"]).select("component", "sig", "text").dropDuplicates(["component", "sig"])
    members = materialize(map_batches(read, with_shingles, "component long, sig long, shingles binary"), "members")

    sizes = members.groupBy("component").count()
    large = materialize(sizes.where(F.col("count") > together).select("component"), "large-groups")
    rows = ["component", "i", "j", "right", "sig", "grp", "shingles"]
    small = members.join(large, "component", "left_anti").select("component", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(False).alias("right"), "sig", F.col("sig").alias("grp"), "shingles")
    edges = None
    if not large.isEmpty():
        edges, tiles = _tiles(members.join(large, "component"), least, together)
        small = small.unionByName(tiles.select(*rows))
    dealt = small.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    joined = dealt.select(*rows).mapInArrow(lambda it: _verified(it, least), "a long, b long")
    parts = connected_components(joined if edges is None else joined.unionByName(edges))
    named = distinct.join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(first, "component").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def _tiles(members: DataFrame, least: float, together: int) -> tuple[DataFrame, DataFrame]:
    """Of large candidate groups: edges to a few pivots of each, and tiles of the members that these leave apart.

    Members that pivots join are dealt out by themselves, and tiles within them are left out: all their pairs are joined.
    """
    by = Window.partitionBy("component").orderBy("sig")
    names = members.select("component", "sig").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= PIVOTS).drop("nth")
    pivots = members.join(names, ["component", "sig"]).select("component", F.col("sig").alias("pivot"), F.col("shingles").alias("other"))

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, x, y = batch.columns
        keep = [bool(similar([np.frombuffer(s, np.uint64)], np.frombuffer(t, np.uint64), least)[0]) for s, t in zip(x.to_pylist(), y.to_pylist())]
        return pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    # the pivots of all large groups grow with the corpus: both sides are dealt by group and salt, so no group is one task
    salted = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = members.withColumn("_salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).join(salted, ["component", "_salt"])
    met = met.select("sig", "pivot", "shingles", "other")
    edges = materialize(map_batches(met, close, "a long, b long"), "pivot-edges")
    grouped = members.join(connected_components(edges).toDF("sig", "grp"), "sig", "left").withColumn("grp", F.coalesce("grp", "sig"))
    pool = grouped.groupBy("component", "grp").count().where(F.col("count") > together / 4).select("component", "grp", F.col("grp").alias("pool"))
    pooled = grouped.join(pool, ["component", "grp"], "left")
    held = pooled.groupBy("component", "pool").agg(F.ceil(F.count("*") / together).cast("int").alias("n")).toDF("_component", "_pool", "n")
    where = F.expr("_component = component AND _pool <=> pool")
    dealt = pooled.join(held, where).select("component", "pool", "sig", "grp", "shingles", F.pmod(F.xxhash64("sig"), "n").cast("int").alias("c"))
    number = F.xxhash64("component", F.coalesce("pool", F.lit(0)), F.col("pool").isNull(), "c")
    dealt = materialize(dealt.withColumn("chunk", number).drop("c"), "chunks")
    chunks = dealt.select("component", "pool", "chunk").distinct()
    left, right = chunks.toDF("component", "p", "i"), chunks.toDF("component", "q", "j")
    pairs = left.join(right, "component").where("i <= j AND NOT (p IS NOT NULL AND p <=> q)").select("component", "i", "j")
    sides = pairs.select("component", "i", "j", F.col("i").alias("chunk"), F.lit(False).alias("right"))
    sides = sides.unionByName(pairs.where("i < j").select("component", "i", "j", F.col("j").alias("chunk"), F.lit(True).alias("right")))
    return edges, dealt.drop("pool").join(sides, ["component", "chunk"])


def keep_one_each(docs: DataFrame, least: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component.

    Repeated rows of that doc_id all stay; so do rows without a doc_id, as nothing names them.
    """
    parts = near_copies(docs, least, words)
    kept = parts.where("doc_id = component_id").select("doc_id").distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(kept, docs["doc_id"] == kept["doc_id"], "left_semi")
    return with_id.unionByName(docs.where("doc_id IS NULL"))
