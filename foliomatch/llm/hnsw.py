"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.topk import clean_vectors
from foliomatch.operators.graph import connected_components
from foliomatch.plans.stages import materialize, shuffle_partitions

#: Shards are at least so many, and hold about so many vectors at most. Queries visit them in blocks of so many rows at
#: most: a shard with its graph is sent out once for each block, so blocks are as large as a task can hold.
LEAST_SHARDS, SHARD_ROWS, BLOCK_ROWS = 3, 65_536, 131_072
#: Where cores would be idle, blocks are smaller, but not below so many rows.
LEAST_BLOCK = 8192
#: Links of a node (twice as many on the ground layer), beam while building and at first while searching.
LINKS, BUILD_BEAM, BEAM = 12, 40, 24
#: Queries with links, and links of theirs, that the audit of a shard wants, and the mean recall a query that they must reach.
AUDIT_QUERIES, AUDIT_PAIRS, RECALL = 512, 2048, 0.98
#: Queries that a beam takes together, and nodes of each that it looks around at once.
STEP, EXPAND = 256, 3
SLACK = 1e-5


class Graph:
    """A navigable small-world graph over unit vectors, built and searched many queries at a time."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, links: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        u = (_mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(np.int32), 8)
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0]) if n else -1
        if links is not None:
            self.layers = np.split(links, range(2 * LINKS, links.shape[1], LINKS), axis=1)
            return
        self.layers = [np.full((n, LINKS if layer else 2 * LINKS), -1, np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            some = order[done : done + min(STEP, max(8, done))]
            self._insert(some, order[:done])
            done += len(some)

    def links(self) -> np.ndarray:
        """All layers side by side, a row for each node, to be given back as ``links``."""
        return np.concatenate(self.layers, 1)

    def _insert(self, new: np.ndarray, old: np.ndarray) -> None:
        entry = np.full(len(new), old[0] if len(old) else -1, np.int32)
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -2)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = self.level[new] >= layer
            if len(old):
                ids, sims = self.beam(self.x[new], entry[:, None], layer, BUILD_BEAM if here.any() else 1)
                entry = ids[:, 0]
            else:
                ids, sims = np.empty((len(new), 0), np.int32), np.empty((len(new), 0), np.float32)
            if not here.any():
                continue
            some, mine = new[here], here.nonzero()[0]
            peers = among[np.ix_(mine, mine)]
            ids = np.concatenate([ids[here], np.broadcast_to(some, (len(some), len(some)))], 1)
            sims = np.concatenate([np.where(ids[:, : sims.shape[1]] >= 0, sims[here], -2), peers], 1)
            self._link(some, ids, sims, layer)

    def _link(self, some: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        """Neighbours that are nearer to the new node than to each other, then the nearest of the rest; and back links."""
        width = min(BUILD_BEAM, ids.shape[1])
        top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        v = self.x[ids]
        near = v @ v.transpose(0, 2, 1)
        good = np.zeros(ids.shape, bool)
        for j in range(width):
            blocked = (good & (near[:, j, :] > sims[:, j, None])).any(1)
            good[:, j] = ~blocked & (sims[:, j] > -2) & (good.sum(1) < LINKS)
        first = np.argsort(~good, axis=1, kind="stable")[:, :LINKS]
        picked = np.where(np.take_along_axis(sims, first, 1) > -2, np.take_along_axis(ids, first, 1), -1)
        table = self.layers[layer]
        table[some, : picked.shape[1]] = picked
        self._link_back(table, picked.ravel(), some.repeat(picked.shape[1]))

    def _link_back(self, table: np.ndarray, to: np.ndarray, come: np.ndarray) -> None:
        """Links from ``to`` to the new nodes ``come``; a node with too many keeps the nearest, and far ones by turns, so
        that a dense clump stays reachable from outside."""
        ok = to >= 0
        to, come = to[ok], come[ok]
        known = (table[to] == come[:, None]).any(1)
        to, come = to[~known], come[~known]
        if not len(to):
            return
        by = np.argsort(to, kind="stable")
        to, come = to[by], come[by]
        start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        n_new = np.diff(np.r_[start, len(to)])
        nodes, nth = to[start], np.arange(len(to)) - np.repeat(start, n_new)
        have, width = (table[nodes] >= 0).sum(1), table.shape[1]
        room = np.repeat(have + n_new <= width, n_new)
        table[to[room], (np.repeat(have, n_new) + nth)[room]] = come[room]
        keep = width * 3 // 4
        full = np.flatnonzero(have + n_new > width)
        full = full[np.argsort(n_new[full], kind="stable")]
        for at in range(0, len(full), STEP):  # nodes with like numbers of new links together, so that little is padded
            some = full[at : at + STEP]
            most = int(n_new[some].max())
            take = start[some, None] + np.arange(most)
            new = np.where(np.arange(most) < n_new[some, None], come[np.minimum(take, len(come) - 1)], -1)
            ids = np.concatenate([table[nodes[some]], new], 1)
            sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", self.x[ids], self.x[nodes[some]]), -3)
            ids = np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable"), 1)
            turns = np.maximum(1, (have[some] + n_new[some] - keep) // (width - keep))
            far = keep + np.arange(width - keep) * turns[:, None]
            table[nodes[some]] = np.concatenate([ids[:, :keep], np.take_along_axis(ids, far, 1)], 1)

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sims)`` of the ``width`` best nodes found for each query, best first; -1 where there are fewer."""
        table, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        ids = np.full((len(q), width), -1, np.int32)
        sims = np.full((len(q), width), -2, np.float32)
        ids[:, : start.shape[1]] = start[:, :width]
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("bkd,bd->bk", self.x[start], q), -2)[:, :width]
        seen[rows[:, None], ids] = True
        todo = ids >= 0
        live = rows
        steps = min(EXPAND, width)
        while len(live):
            score = np.where(todo[live], sims[live], -3)
            at = np.argpartition(-score, steps - 1, axis=1)[:, :steps] if width > 1 else np.zeros((len(live), 1), np.int64)
            go = np.take_along_axis(score, at, 1) > -3
            alive = go.any(1)
            live, at, go = live[alive], at[alive], go[alive]
            if not len(live):
                break
            todo[live[:, None], at] = False
            near = np.where(go[:, :, None], table[ids[live[:, None], at]], -1).reshape(len(live), -1)
            near.sort(1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            # nodes met anew to the front, so that little is looked at in vain
            most = max(1, int(new.sum(1).max()))
            front = np.argsort(~new, axis=1, kind="stable")[:, :most]
            near, new = np.take_along_axis(near, front, 1), np.take_along_axis(new, front, 1)
            sim = np.where(new, np.einsum("bkd,bd->bk", self.x[near], q[live]), -2)
            all_ids = np.concatenate([ids[live], np.where(new, near, -1)], 1)
            all_sims = np.concatenate([sims[live], sim], 1)
            all_todo = np.concatenate([todo[live], new], 1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], todo[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_todo))
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` with similarity of at least ``least``; a full beam is read on over the whole shard."""
        entry = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(q, entry, layer, 1)[0]
        ids, sims = self.beam(q, entry, 0, min(width, len(self.x)))
        hit = sims >= least
        full = hit.all(1) & (ids.shape[1] < len(self.x))
        a, b = np.nonzero(hit & ~full[:, None])
        found, nodes = [a], [ids[a, b]]
        if full.any():
            a, b = self.all_within(q[full], least)
            found.append(full.nonzero()[0][a])
            nodes.append(b)
        return np.concatenate(found), np.concatenate(nodes)

    def all_within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(q @ self.x.T >= least)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _components(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Labels after joining ``a`` and ``b`` elementwise, by taking the least label until nothing moves."""
    while len(a):
        least = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], least)
        np.minimum.at(parent, parent[b], least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def audited_width(graph: Graph, ids: np.ndarray, least: float) -> int:
    """The beam with which audited members of a shard find their links in it: ``RECALL`` on average over queries.

    Members are taken in order of hash until ``AUDIT_QUERIES`` with ``AUDIT_PAIRS`` links are found that do not fill the
    first beam, at most all. A link to itself does not count, nor does a query without links. At each beam a query whose
    links fill it and that finds all has read the whole shard, and is left out; where no other is left the beam stays.
    """
    n, order = len(ids), np.argsort(_mix(ids.astype(np.uint64)), kind="stable")
    few, many, pairs = {}, {}, 0

    def count(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.bincount(a[some[a] != b], minlength=len(some))

    for at in range(0, n, STEP):
        some = order[at : at + STEP]
        for m, links in zip(some.tolist(), count(*graph.all_within(graph.x[some], least), some).tolist()):
            if 0 < links < BEAM - 1:
                few[m] = links
                pairs += links
            elif links and len(many) < AUDIT_QUERIES:
                many[m] = links
        if len(few) >= AUDIT_QUERIES and pairs >= AUDIT_PAIRS:
            break
    truth, width = few | many, BEAM
    asked = np.array(list(truth), np.int64)
    while width < n and len(asked):
        recall = []
        for at in range(0, len(asked), STEP):
            some = asked[at : at + STEP]
            for m, got in zip(some.tolist(), count(*graph.within(graph.x[some], least, width), some).tolist()):
                if got < truth[m] or truth[m] + 1 < width:
                    recall.append(got / truth[m])
        if not recall or np.mean(recall) >= RECALL:
            break
        width *= 2
    return width


def links_of_block(
    v: np.ndarray, vid: np.ndarray, q: np.ndarray, qid: np.ndarray, least: float, links: np.ndarray | None = None, width: int | None = None, keys: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries against one shard: links of each query, and a forest of edges (query id, id) that joins what they join."""
    vn, qn = _unit(v), _unit(q)
    graph, q32 = Graph(vn, vid if keys is None else keys, links), qn.astype(np.float32)
    width = audited_width(graph, vid, least - SLACK) if width is None else width
    counts, parent = np.zeros(len(q), np.int64), np.arange(len(q) + len(v))
    for at in range(0, len(q), STEP):
        a, b = graph.within(q32[at : at + STEP], least - SLACK, width)
        a = a + at
        real = (np.einsum("ij,ij->i", qn[a], vn[b]) >= least) & (qid[a] != vid[b])
        a, b = a[real], b[real]
        counts += np.bincount(a, minlength=len(q))
        parent = _components(a, b + len(q), parent)
    names = np.concatenate([qid, vid])
    moved = parent != np.arange(len(parent))
    return counts, names[moved], names[parent[moved]]


def near_vectors(vectors: DataFrame, least: float = 0.95, column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links long, component_id long, kept boolean)`` for every row of ``vectors(vec_id, embedding, ...)``.

    Two vectors link if their cosine in double precision is at least ``least``. Vectors that are null, zero or hold
    null or non-finite components link with nothing, as do vectors of different lengths. ``n_links`` counts the other
    vectors linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` tells whether it is the own
    one. Rows that repeat a vec_id with another vector are vectors of their own, each compared with all of other ids,
    and the id joins what any of them joins; rows equal in both are one vector, and each of them gets its result. Rows
    without a vec_id link with nothing: their component is null and they are kept. An empty table gives no rows.

    Shards by hash of the row have a graph each, built once, which every block of queries searches. Where it is built, some
    of its members with links are audited against the whole shard, and the beam is doubled until their mean recall is
    ``RECALL``; a query whose beam is full of links reads the whole shard. Links are verified in double precision. A task
    returns link counts and a forest, never the pairs of a group, and components are joined over all tasks.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.col("vec_id").cast("long"), F.col(column).cast("array<double>")).alias("key"))
    clean = clean_vectors(vectors, column).where("vec_id IS NOT NULL").where(F.exists("x", lambda v: v != 0))
    clean = clean.withColumn("key", F.xxhash64("vec_id", "x")).groupBy("key").agg(F.first("vec_id").alias("vec_id"), F.first("x").alias("x"))
    clean = materialize(clean, "vectors")
    n = clean.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    idle = min(-(-2 * shuffle_partitions(spark) // shards), -(-n // LEAST_BLOCK))
    blocks = max(1, -(-n // BLOCK_ROWS), idle)

    def part(m: int, seed: int):
        return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(m)).cast("int")

    def to(m: int):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), t.column("vec_id").to_numpy()

    def build(t: pa.Table) -> pa.Table:
        v, vid = matrix(t)
        graph = Graph(_unit(v), t.column("key").to_numpy())
        width = audited_width(graph, vid, least - SLACK)
        rows = [r.tobytes() for r in graph.links()]
        out = t.append_column("nth", pa.array(range(len(v)), pa.int32())).append_column("links", pa.array(rows, pa.binary()))
        return out.append_column("width", pa.array([width] * len(v), pa.int32()))

    names = ["key", "n", "a", "b"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        left = left.sort_by("nth")
        (v, vid), (q, qid) = matrix(left), matrix(right)
        graph = np.frombuffer(b"".join(left.column("links").to_pylist()), np.int32).reshape(len(v), -1)
        keys = left.column("key").to_numpy(), right.column("key").to_numpy()
        counts, a, b = links_of_block(v, vid, q, qid, least, graph, left.column("width")[0].as_py(), keys[0])
        has = counts > 0
        none = lambda k: pa.nulls(int(k), pa.int64())
        rows = [[pa.array(keys[1][has]), pa.array(counts[has]), none(has.sum()), none(has.sum())], [none(len(a)), none(len(a)), pa.array(a), pa.array(b)]]
        return pa.concat_tables(pa.table(r, names=names) for r in rows)

    dealt = clean.select(F.size("x").alias("dim"), part(shards, 1).alias("shard"), "key", "vec_id", "x")
    graphs = dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, key long, vec_id long, x array<double>, nth int, links binary, width int")
    graphs = materialize(graphs, "graphs")
    by = ["dim", "shard", "block"]
    queries = clean.select(F.size("x").alias("dim"), part(blocks, 2).alias("block"), to(shards).alias("shard"), "key", "vec_id", "x")
    grid = graphs.select("*", to(blocks).alias("block")).groupBy(by).cogroup(queries.groupBy(by))
    found = materialize(grid.applyInArrow(run, ", ".join(f"{x} long" for x in names)), "vector-links")
    counts = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("a IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vec_id")
    out = ids.join(counts, "key", "left").join(parts, "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
