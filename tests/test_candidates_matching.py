"""Candidate pairs, matching and groups on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from foliomatch.functions.fingerprints import hash_to_long
from foliomatch.operators import candidates as ca
from foliomatch.operators import graph as gr
from foliomatch.operators import matching as ma

C = "archive_id long, file_sha256 string, tokens array<string>, path string, mtime_ns long, series_key string, series_date string, series_versioned boolean"
U = "archive_id long, pos int, pixel string, byte string, dhash string, ahash string, area long"


def containers(spark, rows):
    full = [(i, sha, toks, f"/{i}.zip", 0, key, date, ver) for i, sha, toks, key, date, ver in rows]
    return spark.createDataFrame(full, C)


def plain(ids, sha=None, toks=()):
    return [(i, sha or f"s{i}", list(toks), "", "", False) for i in ids]


def units(spark, rows):
    return spark.createDataFrame([(i, p, px, f"b{i}-{p}", d, a, w) for i, p, px, d, a, w in rows], U)


def pages(i, hashes, area=100):
    """Pages whose short hashes share no band with another page's unless they are meant to."""
    return [(i, p, f"px{h}", f"{(h * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64):016x}", f"{(h * 0xC2B2AE3D27D4EB4F + 77) % (1 << 64):016x}", area) for p, h in enumerate(hashes)]


def seeds_of(spark, c, u, **kw):
    return {(r.a, r.b): (list(r.reasons), r.score) for r in ca.candidate_seeds(c, u, **kw).collect()}


def test_exact_star(spark):
    got = seeds_of(spark, containers(spark, plain([3, 1, 2], sha="same")), units(spark, []), series=False)
    assert got == {(1, 2): (["SAME_ARCHIVE_SHA256"], 100), (1, 3): (["SAME_ARCHIVE_SHA256"], 100)}


@pytest.mark.parametrize("tokens,score,reasons", [((), 16, ["LSH_BAND_MATCH"]), (("title",), 18, ["LSH_BAND_MATCH", "SHARED_FILENAME_TOKEN_WITH_VISUAL_HIT"]), (("001", "volume1"), 16, ["LSH_BAND_MATCH"])])
def test_two_slots_and_tokens(spark, tokens, score, reasons):
    u = units(spark, [(1, p, f"a{p}", "0" * 16, "f" * 16, 1) for p in (0, 1)] + [(2, p, f"b{p}", "0001000100010001", "1" * 16, 1) for p in (0, 1)])
    assert seeds_of(spark, containers(spark, plain([1, 2], toks=tokens)), u, series=False) == {(1, 2): (reasons, score)}


def test_tokens_alone_and_one_slot_are_not_enough(spark):
    c = containers(spark, plain([1, 2], toks=("title",)))
    assert seeds_of(spark, c, units(spark, []), series=False) == {}
    assert seeds_of(spark, c, units(spark, [(i, 0, "x", "0" * 16, "0" * 16, 1) for i in (1, 2)]), series=False) == {}


def test_crowded_bucket_makes_no_pairs(spark):
    ids = range(1, 252)
    u = units(spark, [(i, p, "same", "0" * 16, "0" * 16, 1) for i in ids for p in (0, 1)])
    assert seeds_of(spark, containers(spark, plain(ids)), u, series=False) == {}
    d = ca.diagnostics(containers(spark, plain(ids)), u).first()
    assert d.discarded_buckets == 2 * (1 + 14) and d.observations == 0


def test_caps_do_not_depend_on_order(spark):
    rows = [(i, p, "shared" if p < 3 else f"{i}-{p}", f"{i:08x}{p:08x}", f"{p:08x}{i:08x}", 1) for i in range(1, 121) for p in range(4)]
    c = plain(range(1, 121))
    one = seeds_of(spark, containers(spark, c), units(spark, rows), series=False)
    two = seeds_of(spark, containers(spark, c[::-1]), units(spark, rows[::-1]), series=False)
    assert one == two and one
    ends = [x for pair in one for x in pair]
    assert max(map(ends.count, set(ends))) <= ca.MAX_PAIRS


def test_dated_series_neighbours(spark):
    rows = [(1, "a", [], "story", "", False), (2, "b", [], "story", "2024-01-01", True), (3, "c", [], "story", "2024-02-29", True), (4, "d", [], "other", "", False), (5, "e", [], "other", "", False)]
    assert seeds_of(spark, containers(spark, rows), units(spark, [])) == {(1, 2): (["DATED_SERIES_TITLE"], 0), (2, 3): (["DATED_SERIES_TITLE"], 0)}


def test_stable_rank_equals_integer_arithmetic(spark):
    from foliomatch.functions.fingerprints import RANK_FACTORS, RANK_MIXERS, with_pair_rank

    pairs = [(i, i * 7919 + 3) for i in range(1, 60)] + [(-5, 1 << 40), (2**63 - 1, -(2**63))]
    df = with_pair_rank(spark.createDataFrame(pairs, "a long, b long"), 5, 2, "r")
    m = (1 << 64) - 1
    for r in df.collect():
        h = 0
        for x, f in zip((5, 2, r.a, r.b), RANK_FACTORS):
            h ^= x % (1 << 64) * f & m
        h = (h ^ h >> 30) * RANK_MIXERS[0] & m
        h = (h ^ h >> 27) * RANK_MIXERS[1] & m
        assert r.r == (h ^ h >> 31) - (1 << 63)


def classify(spark, left, right, reasons=("LSH_BAND_MATCH",), sha=("x", "y"), stable=(True, True), areas=(100, 100)):
    c = spark.createDataFrame([(1, sha[0], stable[0], None if stable[0] else "CHANGED"), (2, sha[1], stable[1], None)], "archive_id long, file_sha256 string, stable boolean, error string")
    u = units(spark, pages(1, left, areas[0]) + pages(2, right, areas[1]))
    seeds = spark.createDataFrame([(1, 2, list(reasons))], "a long, b long, reasons array<string>")
    return ma.classify_pairs(seeds, c, u).first()


def test_decision_ladder(spark):
    ten = list(range(10))
    r = classify(spark, ten, ten, sha=("same", "same"))
    assert (r.relation, r.confidence, r.matched, r.recommendation) == ("EXACT_ARCHIVE", 1.0, 10, "MANUAL_EQUIVALENT_PATHS")
    r = classify(spark, ten, ten, areas=(115, 100))
    assert (r.relation, r.recommendation) == ("EXACT_CONTENT", "KEEP_LEFT_HIGHER_RESOLUTION")
    r = classify(spark, [99, *ten], ten, areas=(100, 114))
    assert (r.relation, r.recommendation) == ("VISUAL_VARIANT", "MANUAL") and "FIXED_OFFSET_-1" in r.reasons and r.confidence == pytest.approx(10 / 11)
    r = classify(spark, ten, ten[:5] + [50, 51, 52] + ten[5:])
    assert r.relation == "RELATED" and r.confidence < 0.9
    assert classify(spark, [1, 2], [1, 2, 3]).relation == "RELATED"
    r = classify(spark, ten, ten, stable=(False, True))
    assert (r.relation, r.confidence, r.matched, r.reasons[1:]) == ("RELATED", 0.0, 0, ["UNSTABLE_SOURCE_SNAPSHOT", "CHANGED"])
    r = classify(spark, [40, 41, 42, 43], list(range(30, 46)), reasons=["DATED_SERIES_TITLE"])
    assert (r.relation, r.matched, r.confidence) == ("RELATED", 4, 1.0) and "DATED_SERIES_ADDED_12" in r.reasons
    assert classify(spark, [], []).relation == "RELATED"


@pytest.mark.parametrize("bits,relation", [(0x3F, "VISUAL_VARIANT"), (0x7F, "RELATED")])
def test_hash_distance_bound(spark, bits, relation):
    u = units(spark, [(1, p, f"l{p}", "0" * 16, "0" * 16, 1) for p in range(3)] + [(2, p, f"r{p}", f"{bits:016x}", "0" * 16, 1) for p in range(3)])
    c = spark.createDataFrame([(1, "x"), (2, "y")], "archive_id long, file_sha256 string")
    seeds = spark.createDataFrame([(1, 2, ["LSH_BAND_MATCH"])], "a long, b long, reasons array<string>")
    assert ma.classify_pairs(seeds, c, u).first().relation == relation


@pytest.mark.parametrize(
    "left,right,want",
    [
        ([10, 11, 12, 13], [1, 2, 10, 11, 12, 13, 20], ("CONTAINS", 2, 4)),
        (list(range(10)), [5, 6, 7, 8, 9, 20, 21, 22, 23, 24], ("PARTIAL_OVERLAP", None, 5)),
        (list(range(10)), list(range(10)), None),
        ([1, 2, 3], [7, 8, 9], None),
    ],
)
def test_sequence_relations(spark, left, right, want):
    u = units(spark, pages(1, left) + pages(2, right))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = ma.sequence_relations(pairs, u).collect()
    assert ([(r.relation, r.container, r.matched) for r in got] or [None]) == [want]
    if want and want[0] == "CONTAINS":
        rest = ma.unmatched_units(ma.sequence_relations(pairs, u)).first()
        assert (rest.left_rest, rest.right_rest) == ([], [0, 1, 6])


def test_groups_and_weak_edges(spark):
    rows = [(1, 2, "EXACT_CONTENT", 1.0, 5, "KEEP_LEFT_X"), (2, 3, "RELATED", 0.5, 2, "MANUAL"), (1, 3, "RELATED", 0.1, 1, "MANUAL"), (3, 4, "RELATED", 0.9, 1, "MANUAL"), (8, 9, "VISUAL_VARIANT", 0.95, 9, "KEEP_RIGHT_X")]
    rel = spark.createDataFrame(rows, "a long, b long, relation string, confidence double, matched int, recommendation string")
    groups = gr.groups_of(rel, ma.usable_edge())
    assert {(r.archive_id, r.component) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    edges = gr.edges_in_groups(rel, groups)
    assert edges.count() == 4
    assert {(r.component, r.relation, r.confidence) for r in gr.strongest_edges(edges).collect()} == {(1, "EXACT_CONTENT", 1.0), (8, "VISUAL_VARIANT", 0.95)}
    assert {(r.component, r.archive_id) for r in gr.recommended_member(edges).collect()} == {(1, None), (8, 9)}


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in gr.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert 5000 not in got
    assert gr.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hash_conversion_rejects_other_text(spark):
    df = spark.createDataFrame([("ffffffffffffffff",), ("0" * 15 + "1",), ("zz",), (None,)], "h string").select(hash_to_long(F.col("h")).alias("v"))
    assert [r.v for r in df.collect()] == [-1, 1, None, None]


def test_a_batch_has_one_root(spark):
    rows = containers(spark, plain([1, 2])).withColumn("root_id", F.col("archive_id"))
    with pytest.raises(ValueError):
        ca.candidate_seeds(rows, units(spark, []))


def test_series_neighbours_across_ranges(spark):
    rows = [(i, f"s{i}", [], "story" if i % 3 else "other", f"{i % 50:03d}", True) for i in range(1, 200)]
    got = {(r.a, r.b) for r in ca.dated_series_pairs(containers(spark, rows)).collect()}
    want = set()
    for key in ("story", "other"):
        ids = [r[0] for r in sorted((r for r in rows if r[3] == key), key=lambda r: (r[4], r[0]))]
        want |= {(min(x, y), max(x, y)) for x, y in zip(ids, ids[1:])}
    assert got == want
