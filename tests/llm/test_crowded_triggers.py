"""A frequent line in ever other surroundings: its windows are told apart without gathering its trigger."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
from foliomatch.llm import prefixfree

from tests.llm.test_operators import brute_spans, make, words

LINE = " all rights reserved, printed in the city of the seven hills, third edition of "


def test_frequent_short_line(spark, monkeypatch):
    monkeypatch.setattr(prefixfree, "TOGETHER", 6)
    assert len(LINE) < 100
    rows = [(i, words(1000 + i, 12) + LINE + words(2000 + i % 25, 12), "a") for i in range(60)]
    rows += [(7, rows[7][1], "a"), (8, words(3, 5) + LINE + words(2008, 12), "a"), (None, words(1005, 12) + LINE + words(4, 9), "a"), (70, LINE * 4, "a")]
    got = prefixfree.dedup_substrings(make(spark, rows), 100, 24).collect()
    mine = {(x.doc_id if x.doc_id is not None else -1, x.n_bytes, sum(s.hi - s.lo for s in x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got}
    assert mine == set(brute_spans(rows, 100)) and len(got) == len(rows)


def test_repeated_rows_are_looked_at_once(spark):
    """3,000 equal rows give the spans of one row, whether or not the text repeats itself or another one."""
    rows = [(1, words(5, 80), "a"), (2, words(5, 80)[30:] + words(6, 40) + words(5, 80), "a")]
    docs = make(spark, [*rows, *[rows[1]] * 3000])
    spans = prefixfree.repeated_spans(docs)
    got = {r._id: len(r.spans) for r in spans.collect()}
    assert got == {r._id: len(r.spans) for r in prefixfree.repeated_spans(make(spark, rows)).collect()} and got[2] < 100
    out = prefixfree.dedup_substrings(docs).where("doc_id = 2").groupBy("kept").count().collect()
    assert [r["count"] for r in out] == [3001]


def test_many_rows_without_an_id(spark):
    """Texts without an id are told apart by 64 bits, and each keeps the repeats of its own places."""
    shared = words(9, 60)
    rows = [(None, shared[:200] + words(100 + i, 20), "a") for i in range(40)] + [(None, words(100 + i, 3) + shared, "a") for i in range(40)]
    rows += [(3, words(8, 10) + shared, "a"), (3, words(8, 10) + words(7, 10) + shared, "a"), (4, shared[:200], "a")]
    got = prefixfree.dedup_substrings(make(spark, rows).repartition(3), 100, 24).collect()
    mine = sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, sum(s.hi - s.lo for s in x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got)
    assert mine == brute_spans(rows, 100)
    assert prefixfree._keyed(make(spark, rows)).schema["_key"].dataType.simpleString() == "bigint"


def test_entries_are_equal_by_two_hashes(spark, monkeypatch):
    """With entry hashes that are all alike, the trigger still tells most of them apart: distinct texts stay whole."""
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda raw: 7)
    run = prefixfree._parse
    rows = [(i, words(500 + i, 40).encode()) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows]), pa.array([t.decode() for _, t in rows])], ["_id", "_key", "text"])

    class Docs:
        def mapInArrow(self, fn, schema):
            return list(fn(iter([batch])))

    out = run(Docs(), 100, 24)
    assert sum(b.num_rows for b in out) > 10 and all(b.column(1).null_count == 0 for b in out)


def test_a_crowded_trigger_is_not_held(monkeypatch):
    """40,000 entries of one trigger pass, chunk by chunk and window by window, in the memory of a few chunks."""
    monkeypatch.setattr(prefixfree, "CHUNK", 100)
    r = random.Random(2)

    def entries():
        for at in range(0, 40_000, 500):
            some = [r.randbytes(76) + b"t" * 24 + r.randbytes(76) for _ in range(500)]
            ids = list(range(at, at + 500))
            yield pa.RecordBatch.from_arrays([pa.array([5] * 500), pa.array(ids), pa.array(ids), pa.array([90] * 500), pa.array([76] * 500, pa.int32()), pa.array(some)], ["trigger", "id", "key", "at", "before", "entry"])

    tracemalloc.start()
    n = spans = 0
    for batch in prefixfree._windows(entries(), 100, 24):
        n += batch.num_rows
        if n < 100_000:
            spans += sum(b.num_rows for b in prefixfree._later_windows(iter([batch]), 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 * 77 and spans == 0 and peak < 20 << 20
