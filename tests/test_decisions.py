"""Decisions by aggregates against the same rules pair by pair, inventory operators, and what stages refuse."""

import random
from itertools import combinations
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliomatch.operators import inventory as iv
from foliomatch.operators import recommend as rc
from foliomatch.operators import review as rv
from foliomatch.operators import tables as tb
from foliomatch.plans import stages
from foliomatch.plans.ranges import sums_before

INPUTS = "set_key string, archive_id long, root long, file_size long, page_count long, mtime_ns long, resolution_area long, title_rank int, language string, mosaic_rank int, color_rank int, language_source string"


def random_sets(seed, n_sets=40):
    r = random.Random(seed)
    rows, pairs, bridges, i = [], [], [], 0
    for s in range(n_sets):
        ids = list(range(i + 1, i + 1 + r.randint(1, 6)))
        i = ids[-1]
        root = {x: r.choice([x, *(y for y in ids if y < x)]) if r.random() < 0.4 else x for x in ids}
        for x in ids:
            while root[root[x]] != root[x]:
                root[x] = root[root[x]]
        easy = r.random() < 0.5
        for x in ids:
            odd = lambda good, bad, p=0.1: bad if r.random() < p and not easy else good  # noqa: E731, B023
            lang = odd(r.choice(["KOREAN", "ENGLISH"]), "UNKNOWN")
            source = odd("precision", r.choice(["precision_unknown", "filename", "unknown"]))
            top = x == ids[-1] and r.random() < 0.6
            rows.append((f"s{s}", x, root[x], 1000 + (500 if top else r.choice([0, 5])), odd(10, None), r.choice([0, 10**9, 5 * 10**9]), odd(100, r.choice([0, 101, 120])), 3 if top else r.choice([1, 2]), lang, r.choice([None, 1, 3]), 1, source))
        named = {(a, b) for a, b in combinations(ids, 2) if r.random() < (1.0 if easy else 0.5)}
        pairs += [(f"s{s}", a, b) for a, b in named]
        roots = sorted(set(root.values()))
        bridges += [(f"s{s}", a, b, "TIE") for a, b in combinations(roots, 2) if r.random() < 0.3]
    return rows, pairs, bridges


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_count_like_their_pairs(spark, seed):
    rows, pairs, bridges = random_sets(seed)
    inputs = spark.createDataFrame(rows, INPUTS)
    root = {r[1]: (r[0], r[2]) for r in rows}
    bridged = {(s, a, b) for s, a, b, _ in bridges}
    named = {(a, b) for _, a, b in pairs}
    every = []
    for a, b in combinations(sorted(root), 2):
        (s, x), (t, y) = root[a], root[b]
        if s == t and (x == y or (s, min(x, y), max(x, y)) in bridged or (a, b) in named):
            every.append((a, b, x == y))
    evidence = spark.createDataFrame(every, "a long, b long, content_equivalent boolean")
    by_pairs = rc.evidence_counts(inputs.drop("root"), evidence)
    by_class = rc.class_counts(inputs, spark.createDataFrame(pairs, "s string, a long, b long").select("a", "b"), spark.createDataFrame(bridges, "set_key string, c1 long, c2 long, direction string"))
    some = lambda df: {(r.set_key, r.archive_id): tuple(r[c] for c in rc.COUNTS) for r in df.collect() if any(r[c] for c in rc.COUNTS)}
    assert some(by_class) == some(by_pairs)
    # all decisions, by either, and against the rules applied to every pair of a set
    plain = lambda df: {r.archive_id: (r.status, r.recommendation) for r in df.collect()}
    direct = spark.createDataFrame([(a, b, False) for a, b in named], "a long, b long, content_equivalent boolean")
    got = plain(rc.recommend(inputs.drop("root"), evidence))
    assert plain(rc.recommend(inputs, direct, counts=by_class)) == got

    full = rc._compared(rc.pairs_in_sets(inputs.drop("root")).join(evidence.toDF("l_archive_id", "r_archive_id", "ev"), ["l_archive_id", "r_archive_id"], "left"))
    sided = {}
    for r in rc.both_ways(full).withColumn("wins", F.col("has_evidence") & rc.dominates()).collect():
        sided.setdefault((r.set_key, r.archive_id), []).append(r)
    rolled = {(r.set_key, r.archive_id): r for r in rc.rolled_up(inputs.drop("root"), by_pairs).collect()}
    assert rolled.keys() == sided.keys()
    for key, others in sided.items():
        for c in rc.CRITERIA:
            seen = {o[c] for o in others}
            want = "UNKNOWN" if "UNKNOWN" in seen else "MIXED" if {"LEFT_BETTER", "RIGHT_BETTER"} <= seen else next(iter(seen - {"TIE"}), "TIE")
            assert rolled[key][c] == want, (key, c)
    for s in {r[0] for r in rows}:
        mine = {k[1]: v for k, v in sided.items() if k[0] == s}
        winners = [x for x, others in mine.items() if all(o.wins for o in others)]
        kept = [x for x in mine if got[x] == ("RECOMMENDED", "KEEP")]
        if any(o.review for v in mine.values() for o in v):
            assert not kept
        elif mine and not all(o.equivalent for v in mine.values() for o in v) and not any(o[c] == "UNKNOWN" for v in mine.values() for o in v for c in rc.CRITERIA):
            assert kept == winners
    assert any(v == ("RECOMMENDED", "KEEP") for v in got.values())


def test_exact_roots_stay_inside_groups(spark):
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)], "component long, archive_id long")
    rel = spark.createDataFrame([(1, 2, "EXACT_ARCHIVE"), (2, 3, "VISUAL_VARIANT"), (3, 4, "EXACT_CONTENT"), (5, 4, "EXACT_CONTENT")], "a long, b long, relation string")
    assert {(r.archive_id, r.root) for r in rc.exact_roots(groups, rel).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}


def test_coverage_needs_just_the_units(spark):
    units = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "archive_id long, pos int")
    cached = spark.createDataFrame([(1, 0, "FULL"), (1, 1, "PROBE"), (2, 0, "FULL"), (2, 0, "PROBE"), (3, 0, "FULL"), (3, 1, "FULL"), (9, 0, "FULL")], "archive_id long, pos int, coverage string")
    assert {r.archive_id: r.complete for r in iv.full_coverage(units, cached).collect()} == {1: False, 2: True, 3: False, 9: False}


def test_unreviewed_members_are_kept_once(spark):
    members = spark.createDataFrame([(1, 1, False, None), (2, 1, False, None), (1, 2, True, None), (1, 3, False, "FAILED"), (1, 4, False, "RESTORED"), (1, 5, False, None)], "component long, archive_id long, deleted boolean, quarantine string")
    state = spark.createDataFrame([(1, None, False), (4, "HOLD", True), (5, "HOLD", False)], "archive_id long, action string, needs_review boolean")
    assert sorted(r.archive_id for r in rv.keep_unreviewed(members, state).collect()) == [1, 4]


def test_report_files(spark, tmp_path):
    rows = [("/b", "zip", "INDEXED", 1, 2, 3, 4, None, None), ("=a", "zip", "Failed", None, None, 3, 4, "DAMAGED", "x")]
    df = spark.createDataFrame(rows, "path string, archive_format string, state string, image_count int, entry_count int, file_size long, mtime_ns long, error_code string, error_summary string")
    tb.write_report(df, str(tmp_path / "c"), "csv")
    text = b"".join(sorted(p.read_bytes() for p in (tmp_path / "c" / "archives").glob("*.csv"))).decode()
    assert text.startswith("\ufeffpath,archive_format,state") and "'=a,zip" in text
    tb.write_report(df, str(tmp_path / "j"), "json")
    one = spark.read.json(str(tmp_path / "j" / "summary")).first()
    assert (one.total, one.indexed, one.failed, one.pending) == (2, 1, 1, 0)
    with pytest.raises(ValueError):
        tb.write_report(df, str(tmp_path / "x"), "xml")


def test_a_cluster_must_name_the_shared_folder():
    session = lambda master, where: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: where), sparkContext=SimpleNamespace(master=master))
    assert stages.shared_dir(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    with pytest.raises(RuntimeError):
        stages.shared_dir(session("spark://x", None))


def test_sums_before_follow_the_order(spark):
    rows = [(i * 37 % 101 if i % 10 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v long")
    got = sums_before(df, "sums", [F.col("k").asc_nulls_first(), F.col("v").asc()], {"before": F.col("v"), "nth": F.lit(1)}).collect()
    total = 0
    for n, r in enumerate(sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.v))):
        assert (r.before, r.nth) == (total, n)
        total += r.v
