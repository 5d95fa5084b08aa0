"""Generations of tables, regrouping from what changed, and evidence that must still hold."""

import random

import pytest
from pyspark.sql import functions as F

from foliomatch.operators import graph
from foliomatch.sources import generations as ge


def plain_groups(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


def edge_table(spark, edges):
    return spark.createDataFrame(list(edges), "a long, b long")


@pytest.mark.parametrize("seed", range(4))
def test_regrouped_is_a_full_regroup(spark, seed):
    r = random.Random(seed)
    pool = [(a, b) for a in range(60) for b in range(60) if a != b and r.random() < 0.02]
    before = r.sample(pool, len(pool) * 2 // 3)
    after = [e for e in before if r.random() < 0.8] + r.sample(pool, 10) + [(5, 5), (None, 3), (7, 8), (8, 7)]
    groups = spark.createDataFrame(list(plain_groups(before).items()), "archive_id long, component long")
    got = graph.regrouped(groups, edge_table(spark, before), edge_table(spark, after))
    rows = got.collect()
    assert {r.archive_id: r.component for r in rows} == plain_groups(after) and len(rows) == len(plain_groups(after))


@pytest.mark.parametrize("before,after", [([], [(1, 2), (2, 3)]), ([(1, 2), (2, 3)], []), ([], []), ([(1, 2), (3, 4)], [(1, 2), (3, 4), (2, 3)]), ([(1, 2), (2, 3), (1, 3)], [(1, 2), (2, 3)])])
def test_regrouped_borders(spark, before, after):
    groups = spark.createDataFrame(list(plain_groups(before).items()), "archive_id long, component long")
    got = graph.regrouped(groups, edge_table(spark, before), edge_table(spark, after)).collect()
    assert {r.archive_id: r.component for r in got} == plain_groups(after)


def test_only_touched_groups_go_through_the_rounds(spark, monkeypatch):
    before = [(i, i + 1) for i in range(0, 300, 3)] + [(i + 1, i + 2) for i in range(0, 300, 3)]
    after = [e for e in before if e != (30, 31)] + [(60, 90), (500, 501)]
    seen = []
    rounds = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges, **k: (seen.extend(map(tuple, edges.collect())), rounds(edges, **k))[1])
    groups = spark.createDataFrame(list(plain_groups(before).items()), "archive_id long, component long")
    got = graph.regrouped(groups, edge_table(spark, before), edge_table(spark, after)).collect()
    assert {r.archive_id: r.component for r in got} == plain_groups(after)
    # the rest of the group that lost an edge, labels of the two that were joined, and the new pair; nothing of the other 97
    assert sorted(seen) == [(31, 32), (60, 90), (500, 501)]


def test_generations(spark, tmp_path):
    store = ge.Generations(spark, f"file://{tmp_path}/store")
    assert store.latest() == 0 and not store.open().has("x")
    assert store.commit({"x": spark.range(3), "y": spark.range(1)}) == 1
    one = store.open()
    x = one.table("x")
    assert store.commit({"x": spark.range(10)}, after=1) == 2
    # a reader of the first generation keeps it, one of the second sees what was not replaced
    assert (x.count(), one.table("x").count(), store.open(1).table("y").count()) == (3, 3, 1)
    assert (store.open().table("x").count(), store.open().table("y").count()) == (10, 1)
    assert store.commit({("z", "root=1"): spark.range(2), ("z", "root=2"): spark.range(5)}) == 3
    assert store.commit({("z", "root=1"): spark.range(4)}) == 4
    assert (store.open().table("z").count(), store.open().table("z", "root=1").count(), store.open(3).table("z").count()) == (9, 4, 7)


def test_a_writer_that_was_overtaken_changes_nothing(spark, tmp_path):
    store, other = (ge.Generations(spark, f"file://{tmp_path}/store") for _ in range(2))
    store.commit({"x": spark.range(3)})
    other.commit({"x": spark.range(4)})
    with pytest.raises(ge.Conflict):
        store.commit({"x": spark.range(5)}, after=1)
    assert store.latest() == 2 and store.open().table("x").count() == 4
    assert sorted(p.name for p in (tmp_path / "store/generations/0000000002").iterdir() if not p.name.startswith(".")) == ["manifest.json"]
    # both saw the place free: the second rename ends inside the folder of the first and is found out
    blind = Blind(other._fs)
    other._fs = blind
    with pytest.raises(ge.Conflict):
        other._publish(2, {})
    assert blind.asked and store.open().table("x").count() == 4


class Blind:
    """A file system that says that nothing is there."""

    def __init__(self, fs):
        self.fs, self.asked = fs, False

    def exists(self, path):
        self.asked = True
        return False

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_a_killed_writer_leaves_the_old_generation(spark, tmp_path):
    store = ge.Generations(spark, f"file://{tmp_path}/store")
    store.commit({"x": spark.range(3)})
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.commit({"y": spark.range(2), "x": broken})
    assert store.latest() == 1 and store.open().table("x").count() == 3 and not store.open().has("y")
    gone = store.expire(keep=1)
    assert gone and store.open().table("x").count() == 3


def test_expired_generations_go(spark, tmp_path):
    store = ge.Generations(spark, f"file://{tmp_path}/store")
    for n in range(1, 5):
        store.commit({"x": spark.range(n)} | ({"y": spark.range(7)} if n == 1 else {}))
    assert len(store.expire(keep=2)) == 2
    assert store.open(3).table("x").count() == 3 and store.open().table("y").count() == 7
    with pytest.raises(Exception):
        store.open(1)


def test_replace_relations(spark, tmp_path):
    store = ge.Generations(spark, f"file://{tmp_path}/store")
    s = "a long, b long, relation string"
    usable = F.col("relation") != "RELATED"
    first = [(1, 2, "EXACT"), (2, 3, "EXACT"), (4, 5, "EXACT"), (3, 4, "RELATED")]
    assert ge.replace_relations(store, "root=1/version=1", spark.createDataFrame(first, s), usable) == 1
    ge.replace_relations(store, "root=2/version=1", spark.createDataFrame([(9, 10, "EXACT")], s), usable)
    one = store.open(1)
    second = [(2, 3, "EXACT"), (4, 5, "EXACT"), (3, 4, "EXACT")]
    ge.replace_relations(store, "root=1/version=1", spark.createDataFrame(second, s), usable)
    groups = lambda g, p="root=1/version=1": {r.archive_id: r.component for r in g.table("groups", p).collect()}
    assert groups(one) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert groups(store.open()) == {2: 2, 3: 2, 4: 2, 5: 2} and groups(store.open(), "root=2/version=1") == {9: 9, 10: 9}
    assert store.open().table("relations").count() == 4
    with pytest.raises(ValueError):
        ge.replace_relations(store, "root=1/version=1", spark.createDataFrame([(1, 1, "EXACT")], s), usable)
