"""Text, date, sampling and language functions, archive sources, tables, streams, and all registered SQL."""

import datetime as dt
import hashlib
import os
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomatch.functions import fingerprints as fp
from foliomatch.functions import text as tx
from foliomatch.operators import editions as ed
from foliomatch.operators import recommend as rc
from foliomatch.operators import review as rv
from foliomatch.operators import tables as tb
from foliomatch.plans import registry
from foliomatch.sources import archives as ar
from foliomatch.streaming import ledger as sl

D = dt.date


DATED = [
    ("Harbour 2019.03.05", "harbour", D(2019, 3, 5), D(2019, 3, 5), False, True),
    ("Harbour 20190305", "harbour", D(2019, 3, 5), D(2019, 3, 5), False, True),
    ("Harbour 2020년 2월", "harbour 월", D(2020, 2, 1), D(2020, 2, 29), False, True),
    ("Harbour 2020년 2월 9일 notes", "harbour notes", D(2020, 2, 9), D(2020, 2, 9), False, True),
    ("Harbour 2019-12 ~ 2020-02 wip", "harbour", D(2019, 12, 1), D(2020, 2, 29), True, True),
    ("Harbour 20191201 to 20200115", "harbour", D(2019, 12, 1), D(2020, 1, 15), True, True),
    ("Harbour 20200115 to 20191201", "harbour 20200115 to 20191201", None, None, False, False),
    ("Harbour 20191201 and 20200115", "harbour 20191201 and 20200115", None, None, False, False),
    ("Harbour 2019-2021 Ongoing", "harbour", D(2019, 1, 1), D(2021, 12, 31), True, True),
    ("Harbour 2021-2019", "harbour 2021 2019", None, None, False, False),
    ("Harbour 2019.02.29", "harbour 2019 02 29", None, None, False, False),
    ("Harbour 2019.00", "harbour 2019 00", None, None, False, False),
    ("Harbour 120190305", "harbour 120190305", None, None, False, False),
    ("Harbour_Tales ２０１９．０３", "harbour tales", D(2019, 3, 1), D(2019, 3, 31), False, True),
    ("Harbour updated", "harbour", None, None, False, True),
    ("Harbour uptown", "harbour uptown", None, None, False, False),
    ("", "", None, None, False, False),
]


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(f"shelf/{t}.zip" if t else "", k, a, b, r, v) for t, k, a, b, r, v in DATED]
    df = spark.createDataFrame(rows, "p string, k string, a date, b date, r boolean, v boolean")
    return df.withColumn("t", tx.title_dates(F.col("p"))).collect()


@pytest.mark.parametrize("i", range(len(DATED)))
def test_title_dates(dated, i):
    r = dated[i]
    assert (r.t.key, r.t.start, r.t.end, r.t.is_range, r.t.versioned) == (r.k, r.a, r.b, r.r, r.v)


def test_dates_fall_back_to_the_last_change(spark):
    day = 86_400_000_000_000
    df = spark.createDataFrame([("Harbour 20190305.zip", 5 * day), ("Harbour.zip", 5 * day), ("Harbour.zip", -1), (None, None)], "p string, m long")
    t = tx.title_dates(F.col("p"))
    got = [(r.d and (r.d.start, r.d.inferred), r.i.end) for r in df.select(tx.dates_or_mtime(t, F.col("m")).alias("d"), tx.series_identity(t).alias("i")).collect()]
    assert got == [((D(2019, 3, 5), False), "2019-03-05"), ((D(1970, 1, 6), True), ""), (None, ""), (None, "")]


def evidence(spark, *paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return [r.e for r in df.select(tx.filename_evidence(F.col("p")).alias("e")).collect()]


def test_filename_signals(spark):
    a, b, c, d, e, f, g = evidence(
        spark, "shelf/{Blue} Long_Way v.007 (JAPANESE) Full-Colour resized.cbz", "Long Way jpn eng ch.12.zip", "긴 길 제03권.zip", "긴 길 흑백 english.zip", "Long Way no mosaic mosaic.zip", "Way korea 모자이크 제거.zip", None
    )
    assert a.tokens == ["blue", "colour", "full", "long", "volume7", "way"] and a.hints == ["ja"]
    assert (a.language.value, a.language.confidence, a.language.matched) == ("JAPANESE", 0.9, ["japanese"])
    assert (a.color.value, a.color.matched) == ("FULL_COLOR", ["colour", "full"]) and a.mosaic.value is None
    assert b.language.conflict and b.language.value is None and b.language.matched == ["eng", "jpn"] and "chapter12" in b.tokens
    assert (c.language.value, c.language.confidence, c.language.matched) == ("KOREAN", 0.6, ["hangul-title"]) and "volume3" in c.tokens
    assert d.language.value == "ENGLISH" and d.color.value == "MONOCHROME"
    assert e.mosaic.conflict and e.mosaic.matched == ["mosaic", "no"]
    assert (f.mosaic.value, f.language.value, f.language.confidence) == ("DECENSORED", "KOREAN", 0.6)
    assert g.tokens == [] and g.hints == [] and not g.language.conflict


def test_text_functions(spark):
    sizes = spark.createDataFrame([(0, "0 B"), (1023, "1,023 B"), (1024, "1.0 KiB"), (5 << 30, "5.0 GiB")], "n long, want string")
    assert all(r.got == r.want for r in sizes.withColumn("got", tx.file_size_text(F.col("n"))).collect())
    cells = [("=1", "'=1"), (" =1", "' =1"), ("\n1", "'\n1"), ("\t1", "'\t1"), ("\u00a0@x", "'\u00a0@x"), ("a=1", "a=1"), ("", ""), (None, None)]
    df = spark.createDataFrame(cells, "c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", tx.csv_safe(F.col("c"))).collect())
    maps = spark.createDataFrame([({"b": 1, "a": 2},), ({},)], "m map<string,int>")
    assert [r.j for r in maps.select(tx.canonical_json(F.col("m")).alias("j")).collect()] == ['{"a":2,"b":1}', "{}"]
    found = spark.createDataFrame([("Ｌｏｎｇ Straße",)], "t string").select(tx.search_text(F.col("t")).alias("s")).first().s
    assert found == "long strasse"


def test_path_expressions(spark):
    rows = [("a/[x (y)] z.zip", 3), ("［x（y）］ z.zip", 3), ("[x] z.cbz", 2), ("[x].cbz", 1), ("z", 1), ("\u3000.zip", 0), ("", 0)]
    df = spark.createDataFrame(rows, "p string, r int")
    assert all(r.got == r.r for r in df.withColumn("got", tx.title_rank(F.col("p"))).collect())
    names = spark.createDataFrame([("p10.jpg",), ("p2.jpg",), ("P1.JPG",), ("p2a.jpg",), ("p" + "9" * 60 + ".jpg",)], "n string")
    assert [r.n for r in names.orderBy(tx.natural_key(F.col("n"))).collect()] [:4] == ["P1.JPG", "p2.jpg", "p2a.jpg", "p10.jpg"]
    safe = spark.createDataFrame([("a/b.jpg", True), ("../b", False), ("/a", False), ("c:\\x", False), ("a//b", False), (None, False)], "p string, ok boolean")
    assert all(r.got == r.ok for r in safe.withColumn("got", tx.is_safe_member(F.col("p"))).collect())
    crc = spark.createDataFrame([("0xAb", "000000ab"), ("123456789", None), (None, None)], "c string, want string")
    assert all(r.got == r.want for r in crc.withColumn("got", tx.crc_hex(F.col("c"))).collect())
    keys = spark.createDataFrame([("C:\\A\\B/",), ("c:/a//b",)], "p string").select(tx.path_key(F.col("p")).alias("k"))
    assert {r.k for r in keys.collect()} == {"c:/a/b"}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 60), st.integers(1, 12))
def test_interior_positions_are_nested(n, limit):
    small, large = fp.interior_positions(n, limit), fp.interior_positions(n, limit + 1)
    assert set(small) <= set(large) and len(small) <= limit
    assert n < 5 or not {0, n - 1} & set(large)


def test_probe_slots_round_half_to_even(spark):
    df = spark.range(0, 61).select(F.col("id").cast("int").alias("n")).withColumn("s", fp.probe_slots(F.col("n")))
    for r in df.collect():
        want = list(dict.fromkeys(round((r.n - 1) * x) for x in fp.PROBE_SHARES)) if r.n else []
        assert [x.pos for x in r.s] == want and [x.slot for x in r.s] == list(range(len(want)))


def test_language_ladder(spark):
    ko, ja, en = "안녕하세요 여러분\n반갑습니다 친구", "これはとてもたのしいです", "hello there friend"
    rows = [(1, 0, ko), (1, 1, ko), (1, 2, en), (2, 0, ja), (2, 1, ja), (2, 2, ja), (3, 0, en), (4, 0, None), (5, 0, en), (5, 1, "가나다 hello there")]
    ev = ed.page_language(spark.createDataFrame(rows, "archive_id long, pos int, text string"))
    got = {r.archive_id: r.language for r in ed.container_language(ev).collect()}
    assert got == {1: "KOREAN", 2: "JAPANESE", 3: "ENGLISH", 4: "UNKNOWN", 5: "UNKNOWN"}
    hints = spark.createDataFrame([(1, ["JAPANESE"]), (3, ["ENGLISH"])], "archive_id long, languages array<string>")
    got = {r.archive_id: r.language for r in ed.container_language(ev, hints).collect()}
    assert got[1] == "UNKNOWN" and got[3] == "ENGLISH"


def test_editions_and_mosaic(spark):
    scores = spark.createDataFrame([(i, 0.2 if k < n else 0.0) for i, n in ((1, 10), (2, 80), (3, 60), (4, 16)) for k in range(100)], "archive_id long, score double")
    assert {r.archive_id: r.kind for r in ed.edition_profiles(scores).collect()} == {1: "MONOCHROME", 2: "FULL_COLOR", 3: "FULL_COLOR", 4: "MIXED_OR_UNKNOWN"}
    tiles = lambda b, d: ([b] * 4, [d] * 4)
    m = spark.createDataFrame([(1, p, *tiles(1.0, 1.0)) for p in range(3)] + [(2, p, *tiles(2.0, 0.5)) for p in range(3)], "archive_id long, pos int, tile_blockiness array<double>, tile_detail array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 7)], "a long, b long")
    assert {(r.b, r.direction) for r in ed.compare_mosaic(pairs, m).collect()} == {(2, "LEFT_BETTER"), (7, "UNKNOWN")}
    q = spark.createDataFrame([(1, 0, 9.0, 1.0, 1.0, 1.0, 9.0, 1.0), (2, 0, 1.0, 9.0, 9.0, 9.0, 1.0, 9.0), (3, 0, 9.0, 20.0, 1.0, 1.0, 9.0, 1.0)], "archive_id long, pos int, " + ", ".join(f"{k} double" for k in ed.QUALITY_METRICS))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 1)], "a long, b long")
    assert {(r.a, r.b): r.direction for r in ed.compare_quality(pairs, q).collect()} == {(1, 2): "LEFT_BETTER", (2, 3): "UNKNOWN", (1, 1): "TIE"}
    edges = spark.createDataFrame([(1, 2, "RELATED", 5, []), (2, 3, "VISUAL_VARIANT", 3, ["LEFT_MEDIAN_PIXEL_AREA_AT_LEAST_15_PERCENT_LARGER"])], "a long, b long, relation string, matched int, reasons array<string>")
    prof = spark.createDataFrame([(1, 0.1), (2, 0.8), (3, 0.6)], "archive_id long, color_page_ratio double")
    got = {(r.a, r.b): (r.flags, r.preserve) for r in ed.compare_editions(edges, prof, spark.createDataFrame([], "archive_id long, hints array<string>")).collect()}
    assert got == {(1, 2): (["COLOR_MONO"], True), (2, 3): (["EDIT_OR_CENSORSHIP", "QUALITY"], True)}


I = "set_key long, archive_id long, file_size long, page_count long, mtime_ns long, resolution_area long, title_rank int, language string, mosaic_rank int, color_rank int, language_source string"


def member(i, size=1000, pages=10, mtime=0, area=100, title=1, language="KOREAN", source="precision", s=1):
    return (s, i, size, pages, mtime, area, title, language, None, None, source)


def decide(spark, members, pairs):
    ev = spark.createDataFrame(pairs, "a long, b long, content_equivalent boolean")
    return {r.archive_id: (r.status, r.recommendation) for r in rc.recommend(spark.createDataFrame(members, I), ev).collect()}


def test_dominance(spark):
    every = [(1, 2, False), (1, 3, False), (3, 2, False)]
    got = decide(spark, [member(1, size=3000), member(2, size=2000), member(3)], every)
    assert got == {1: ("RECOMMENDED", "KEEP"), 2: ("RECOMMENDED", "REMOVE_CANDIDATE"), 3: ("RECOMMENDED", "REMOVE_CANDIDATE")}
    assert decide(spark, [member(1, size=3000, pages=9), member(2)], [(1, 2, False)])[1] == ("NONE", "NONE")
    assert decide(spark, [member(1, size=1009), member(2, size=1000)], [(1, 2, False)])[1] == ("NONE", "NONE")
    assert decide(spark, [member(1, title=3), member(2)], [(1, 2, False)])[1] == ("RECOMMENDED", "KEEP")
    assert decide(spark, [member(1, mtime=2_000_000_001), member(2)], [(1, 2, False)])[1] == ("RECOMMENDED", "KEEP")
    assert decide(spark, [member(1, size=5000, title=1), member(2, title=2)], [(1, 2, False)])[1] == ("NONE", "NONE")
    assert decide(spark, [member(1, language="UNKNOWN"), member(2)], [(1, 2, False)])[1] == ("ANALYSIS_REQUIRED", "NONE")
    assert decide(spark, [member(1, area=None), member(2)], [(1, 2, False)])[1] == ("ANALYSIS_REQUIRED", "NONE")
    assert decide(spark, [member(1, mtime=5), member(2, size=9000)], [(2, 1, True)])[1] == ("RECOMMENDED", "KEEP")
    assert decide(spark, [member(1)], [])[1] == ("NONE", "NONE")


def test_user_order_and_estimates(spark):
    ev = spark.createDataFrame([(1, 2, False)], "a long, b long, content_equivalent boolean")
    inputs = spark.createDataFrame([member(1, size=1, pages=9, language="UNKNOWN"), member(2, size=5, pages=8)], I)
    pick = lambda *o: {r.archive_id: r.recommendation for r in rc.recommend_by_order(inputs, ev, o).collect()}
    assert pick("pages", "size") == {1: "KEEP", 2: "REMOVE_CANDIDATE"} and pick("size") == {1: "REMOVE_CANDIDATE", 2: "KEEP"}
    assert pick("language", "size") == {1: "NONE", 2: "NONE"} and pick("mosaic", "size")[2] == "KEEP"
    assert [r.language for r in rc.with_estimates(inputs).orderBy("archive_id").collect()] == ["JAPANESE", "KOREAN"]


def test_version_chain(spark):
    days = [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]
    rows = [(*member(i + 1, pages=10 * (i + 1)), "story", d, d, False, d) for i, d in enumerate(days)]
    schema = I + ", series_key string, start date, end date, is_range boolean, mtime_day date"
    ev = spark.createDataFrame([(1, 2, False), (2, 3, False)], "a long, b long, content_equivalent boolean")
    got = {r.archive_id: r.recommendation for r in rc.version_rule(spark.createDataFrame(rows, schema), ev).collect()}
    assert got == {1: "REMOVE_CANDIDATE", 2: "REMOVE_CANDIDATE", 3: "KEEP"}
    rows[0] = (*rows[0][:-4], None, None, None, None)
    got = {(r.recommendation, r.status) for r in rc.version_rule(spark.createDataFrame(rows, schema), ev).collect()}
    assert got == {("NONE", "ANALYSIS_REQUIRED")}


def test_merged_directions_and_bridges(spark):
    d = spark.createDataFrame([(1, 2, "LEFT_BETTER"), (2, 1, "RIGHT_BETTER"), (3, 4, "TIE"), (3, 4, "LEFT_BETTER")], "a long, b long, direction string")
    assert {(r.a, r.b): r.direction for r in rc.merged_directions(d).collect()} == {(1, 2): "LEFT_BETTER", (3, 4): "UNKNOWN"}
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "archive_id long, root long")
    rel = spark.createDataFrame([(1, 2), (3, 1), (2, 3)], "a long, b long")
    m = spark.createDataFrame([(3, 2, "LEFT_BETTER")], "a long, b long, direction string")
    got = {(r.a, r.b): (r.mosaic, r.content_equivalent) for r in rc.pair_evidence(rel, m, roots).collect()}
    assert got == {(1, 2): ("TIE", True), (1, 3): ("RIGHT_BETTER", False), (2, 3): ("RIGHT_BETTER", False)}


def test_table_view_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, 5, "B"), (2, None, "a"), (3, 7, None), (4, 5, "c")], "n int, v int, s string")
    order = lambda **k: [r.n for r in tb.apply_view(df, number="n", **k).collect()]
    assert order(sort=[("v", False)]) == [1, 4, 3, 2] and order(sort=[("v", True)]) == [3, 1, 4, 2]
    assert order(filters=[{"column": "s", "contains": "B"}]) == [1] and order(filters=[{"column": "v", "least": 6}]) == [3]
    assert order(filters=[{"column": "v", "none": True}]) == []


def test_merges(spark):
    s = "k int, coverage string, pixel string, dhash string"
    old, new = spark.createDataFrame([(1, "FULL", "p", None), (2, "PROBE", "q", "d")], s), spark.createDataFrame([(1, "PROBE", None, "e"), (3, "PROBE", "r", None)], s)
    got = {r.k: (r.coverage, r.pixel, r.dhash) for r in rv.merge_fingerprints(old, new, ["k"]).collect()}
    assert got == {1: ("FULL", "p", "e"), 2: ("PROBE", "q", "d"), 3: ("PROBE", "r", None)}


def test_archives(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    with zipfile.ZipFile(root / "b.CBZ", "w") as z:
        for name, data in (("p10.jpg", b"ten"), ("p2.jpg", b"two"), ("dir/", b""), ("inner.zip", b"x"), ("note.txt", b"n")):
            z.writestr(name, data)
    (root / "bad.zip").write_bytes(b"not a zip")
    (root / "c.rar").write_bytes(b"Rar!")
    (root / "skip.txt").write_bytes(b"t")
    found = ar.discover(spark, str(tmp_path / "in"))
    assert sorted(r.format for r in found.collect()) == ["cbz", "rar", "zip"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in")).where("path NOT LIKE '%.txt'")
    members = ar.list_members(files)
    names = [(r.pos, r.member, r.kind) for r in members.where("member IS NOT NULL").orderBy("pos").collect()]
    assert names == [(0, "inner.zip", "NESTED_ARCHIVE"), (1, "note.txt", "OTHER"), (2, "p2.jpg", "IMAGE"), (3, "p10.jpg", "IMAGE")]
    inv = {os.path.basename(r.path): (r.n_members, r.n_images, r.error) for r in ar.inventory(members).collect()}
    assert inv == {"b.CBZ": (4, 2, None), "bad.zip": (0, 0, "DAMAGED"), "c.rar": (0, 0, "UNSUPPORTED_FORMAT")}
    wanted = members.where("kind = 'IMAGE'").select("path", "member", "size", F.when(F.col("member") == "p2.jpg", "00000001").otherwise(F.col("crc")).alias("crc"))
    got = {r.member: (r.payload and bytes(r.payload), r.error) for r in ar.read_members(files, wanted).collect()}
    assert got == {"p10.jpg": (b"ten", None), "p2.jpg": (None, "CRC_MISMATCH")}
    text = "Path = a.jpg\nSize = 3\nCRC = ABCD0123\nEncrypted = -\n\nPath = d\nFolder = +\nSize = 0\n"
    parsed = ar.parse_listing(spark.createDataFrame([("x.7z", text)], "path string, text string")).collect()
    assert [(r.member, r["size"], r.crc, r.encrypted) for r in parsed] == [("a.jpg", 3, "abcd0123", False)]


def test_discovery_by_rounds(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    for name in ("a/b/c/deep.ZIP", "a/one.cbz", "two.7z", "a/skip.txt", "É/three.rar"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    (root / "a" / "link.zip").symlink_to(root / "two.7z")
    (root / "a" / "loop").symlink_to(root)
    (root / "empty").mkdir()
    rows = ar.discover_folders(spark, str(root)).collect()
    assert {(os.path.relpath(r.path, root), r.format, r.file_size, r.code) for r in rows} == {
        ("a/b/c/deep.ZIP", "zip", 5, None), ("a/one.cbz", "cbz", 5, None), ("two.7z", "7z", 5, None), ("É/three.rar", "rar", 5, None)
    } and len(rows) == 4
    assert all(r.mtime_ns == os.stat(r.path).st_mtime_ns for r in rows)
    gone = ar.discover_folders(spark, str(root / "none")).collect()
    assert [(os.path.basename(r.path), r.code, r.file_size) for r in gone] == [("none", "FILE_NOT_FOUND", None)]
    assert ar.discover_folders(spark, str(root / "a" / "loop")).collect() == []
    assert ar.discover_folders(spark, str(root / "empty")).collect() == []
    assert [r.code for r in ar.discover_folders(spark, str(root / "two.7z")).collect()] == ["FILE_NOT_FOUND"]
    long = ar.discover_folders(spark, str(root) + "/" + "x" * 300).collect()
    assert [r.code for r in long] == ["PATH_TOO_LONG"]
    codes = {e: ar._code(OSError(getattr(__import__("errno"), e), "")) for e in ("EACCES", "EPERM", "ENOTDIR", "EIO")}
    assert codes == {"EACCES": "ACCESS_DENIED", "EPERM": "ACCESS_DENIED", "ENOTDIR": "FILE_NOT_FOUND", "EIO": "DISCOVERY_ERROR"}


def test_large_containers_are_read_by_ranges(spark, tmp_path):
    """A container of 2 GiB lists in little memory, though nearly all of it is before the first member."""
    import tracemalloc

    big = tmp_path / "big.zip"
    with open(big, "wb") as f:
        f.truncate(2 << 30)
    with zipfile.ZipFile(big, "a") as z:
        for i in (10, 9):
            z.writestr(f"p{i}.jpg", b"x" * i)
    tracemalloc.start()
    rows = ar._listing(str(big), None, None)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert [r[1:3] for r in rows] == [("p10.jpg", 10), ("p9.jpg", 9)]
    files = ar.discover(spark, str(tmp_path))
    members = ar.list_members(files)
    got = ar.read_members(files, members).collect()
    assert sorted((r.member, len(r.payload)) for r in got) == [("p10.jpg", 10), ("p9.jpg", 9)]


def test_containers_that_change(spark, tmp_path):
    for name in ("a", "b", "c"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("p2.jpg", b"two")
            z.writestr("p10.jpg", b"ten")
    files = ar.discover(spark, str(tmp_path)).select("path", "file_size", "mtime_ns").collect()
    files = spark.createDataFrame(files + [(str(tmp_path / "none.zip"), 5, 5)], "path string, file_size long, mtime_ns long")
    members = spark.createDataFrame(ar.list_members(files).collect())
    want = members.where("member IS NOT NULL")
    name = lambda r: os.path.basename(r.path)
    assert [(name(r), r.error) for r in members.where("member IS NULL").collect()] == [("none.zip", "FILE_NOT_FOUND")]
    good = {(name(r), r.member): bytes(r.payload) for r in ar.read_members(files, want).collect()}
    assert good == {(f"{n}.zip", m): d for n in "abc" for m, d in (("p2.jpg", b"two"), ("p10.jpg", b"ten"))}
    # b is longer now; c has the same length but another member at each place, as the names say
    with zipfile.ZipFile(tmp_path / "b.zip", "a") as z:
        z.writestr("more", b"m")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("p9.jpg", b"two")
        z.writestr("p10.jpg", b"ten")
    codes = lambda f, w: {(name(r), r.member): r.error for r in ar.read_members(f, w).collect()}
    now = codes(files, want)
    assert {k: v for k, v in now.items() if k[0] != "c.zip"} == {("a.zip", "p2.jpg"): None, ("a.zip", "p10.jpg"): None, ("b.zip", "p2.jpg"): "SNAPSHOT_CHANGED", ("b.zip", "p10.jpg"): "SNAPSHOT_CHANGED"}
    bare = files.select("path")
    assert {k: v for k, v in codes(bare, want).items() if k[0] == "c.zip"} == {("c.zip", "p2.jpg"): "ENTRY_CHANGED", ("c.zip", "p10.jpg"): None}
    swapped = want.withColumn("pos", 1 - F.col("pos"))
    assert set(codes(bare, swapped.where("path LIKE '%a.zip'")).values()) == {"ENTRY_CHANGED"}
    digests = {name(r): (r.sha256, r.error) for r in ar.file_digests(files).collect()}
    assert digests["a.zip"] == (hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest(), None)
    assert digests["b.zip"] == (None, "SNAPSHOT_CHANGED") and digests["none.zip"] == (None, "FILE_NOT_FOUND")


def test_damaged_and_crowded_containers(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(6):
            z.writestr(f"{i}.jpg", b"x")
    whole = (tmp_path / "many.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[:-30])
    (tmp_path / "bent.zip").write_bytes(whole.replace(b"PK\1\2", b"PK\1\3"))
    (tmp_path / "nothing.zip").write_bytes(b"")
    broken = bytearray(whole)
    broken[whole.index(b"3.jpg") + 5] ^= 1
    (tmp_path / "flip.zip").write_bytes(bytes(broken))
    codes = {p.name: ar._listing(str(p), None, None)[0][-1] for p in tmp_path.iterdir()}
    assert codes == {"many.zip": None, "cut.zip": "DAMAGED", "bent.zip": "DAMAGED", "nothing.zip": "DAMAGED", "flip.zip": None}
    files = ar.discover(spark, str(tmp_path)).where("path LIKE '%flip.zip'")
    bad = [r.member for r in ar.read_members(files, ar.list_members(files)).where("error = 'MEMBER_UNREADABLE'").collect()]
    assert bad == ["3.jpg"]
    monkeypatch.setattr(ar, "MAX_MEMBERS", 5)
    assert ar._listing(str(tmp_path / "many.zip"), None, None)[0][-1] == "TOO_MANY_MEMBERS"
    monkeypatch.setattr(ar, "MAX_LISTING", 100)
    monkeypatch.setattr(ar, "MAX_MEMBERS", 50)
    assert ar._listing(str(tmp_path / "many.zip"), None, None)[0][-1] == "LISTING_TOO_LARGE"


def test_natural_order_in_tasks_is_that_of_the_column(spark):
    names = ["p10", "p9", "P9b", "a/2", "a\\10", "é1", "e\u03011", "1" * 40, "1" * 39 + "2", "007", "7", "07x", "Ｚ", "", "x" * 3, "0"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = [r.n for r in df.orderBy(ar.natural_key(F.col("n")), "n").collect()]
    assert sorted(names, key=ar._natural) == want


def test_written_containers(spark, tmp_path):
    rows = [(f"c{i % 3}", f"p{i}.txt", bytes([i]) * i if i else None) for i in range(20)]
    df = spark.createDataFrame(rows, "container string, member string, payload binary")
    root = f"file://{tmp_path}/out"
    assert sorted(map(tuple, ar.write_containers(df, root).collect())) == [("c0", 7), ("c1", 7), ("c2", 6)]
    first = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    ar.write_containers(df.repartition(3), root).collect()
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == first and len(first) == 3
    files = ar.discover(spark, root)
    got = {(os.path.basename(r.path)[:-4], r.member, bytes(r.payload)) for r in ar.read_members(files, ar.list_members(files)).collect()}
    assert got == {(c, m, p or b"") for c, m, p in rows}


def test_ledger_streams(spark, tmp_path):
    schema = "id long, archive_id long, action string, ts timestamp"
    src = tmp_path / "ledger"
    t = dt.datetime(2024, 1, 1)
    one = [(1, 7, "HOLD", t), (2, 8, "KEEP", t)]
    two = [(3, 7, "KEEP", t + dt.timedelta(hours=2)), (3, 7, "KEEP", t + dt.timedelta(hours=2))]
    three = [(4, 8, "HOLD", t + dt.timedelta(hours=3)), (1, 9, "KEEP", t)]
    out = tmp_path / "out"
    for rows in (one, two, three):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = sl.keep_latest(sl.stream_ledger(spark, str(src), schema, 1), str(out), str(tmp_path / "ck"), buckets=4)
        q.awaitTermination()
    got = {r.archive_id: (r.id, r.action) for r in sl.read_latest(spark, str(out), schema).collect()}
    assert got == {7: (3, "KEEP"), 8: (4, "HOLD"), 9: (1, "KEEP")}
    assert all(len(list(b.iterdir())) <= 2 for b in out.iterdir() if b.is_dir())
    before = {r.archive_id: r.action for r in sl.read_latest(spark, str(out), schema, before=2).collect()}
    assert before[7] == "KEEP"
    stream = sl.action_windows(sl.distinct_actions(sl.stream_ledger(spark, str(src), schema)), late=None)
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] >= 2


def test_rescan_outcomes(spark):
    s = "path string, file_size long, mtime_ns long"
    known = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], s)
    seen = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], s)
    assert {r.path: r.outcome for r in sl.rescan(known, seen).collect()} == {"a": "REUSED", "b": "CHANGED", "c": "MISSING", "d": "NEW"}
    assert "c" not in {r.path for r in sl.rescan(known, seen, complete=False).collect()}


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, sf, con, name):
    mine, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).to_numpy().tolist()))
    assert rows(mine) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
