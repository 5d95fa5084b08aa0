"""What triggers with very many entries deal out, and what is left of shuffles that are done."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from foliomatch.llm import prefixfree
from foliomatch.plans.stages import materialize
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_spans, make, words

LINE = " all rights reserved, printed in the city of the seven hills, third edition of "


def found(rows):
    return sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, sum(s.hi - s.lo for s in x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in rows)


def test_crowded_triggers_are_dealt_in_proportion(spark, monkeypatch):
    """A line in 300 different surroundings: what is dealt is a few times the texts (all their windows: 62 times)."""
    monkeypatch.setattr(prefixfree, "TOGETHER", 6)
    monkeypatch.setattr(prefixfree, "discard", lambda df: None, raising=False)
    frame = type(spark.range(0))
    dealt, deal = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(self) or deal(self, *a))
    rows = [(i, words(1000 + i, 14) + LINE + words(5000 + i, 14), "a") for i in range(300)]
    got = prefixfree.dedup_substrings(make(spark, rows), 100, 24).collect()
    sizes = [df.agg(F.sum(sum(F.length(c) for c, t in df.dtypes if t == "binary"))).first()[0] or 0 for df in dealt if "binary" in dict(df.dtypes).values()]
    assert found(got) == brute_spans(rows, 100)
    assert 0 < sum(sizes) < 12 * sum(len(t) for _, t, _ in rows)


@pytest.mark.parametrize("length,gram", [(100, 24), (30, 8)])
def test_crowded_to_the_last_part(spark, length, gram, monkeypatch):
    """Beginnings, ends and runs of a word that very many texts share, also at the same few bytes around a trigger."""
    monkeypatch.setattr(prefixfree, "TOGETHER", 2)
    r, shared, begin, end = random.Random(4), words(77, 90), words(78, 6), words(79, 6)
    rows = [(i, words(100 + i, 9) + r.choice(["", begin, begin[-20:]]) + shared + r.choice(["", end, end[:9]]) + words(300 + i, 9), "a") for i in range(25)]
    rows += [(30 + i, words(500 + i % 5, 4) + " be" * r.randint(20, 70) + words(600 + i % 4, 4), "a") for i in range(25)]
    rows += [(None, shared[:160], "a"), (3, words(103, 9) + shared[:150], "a"), (3, words(103, 9) + shared[:180], "a")]
    assert found(prefixfree.dedup_substrings(make(spark, rows), length, gram).collect()) == brute_spans(rows, length)


def test_windows_of_a_group():
    """Windows of random entries of two letters, cut at their texts' ends, against each with each."""
    r, length, gram = random.Random(5), 12, 4
    reach = length - gram + 1
    for turn in range(300):
        rows = []
        for group in range(r.randint(1, 4)):
            for i in sorted(r.choices(range(9), k=r.randint(1, 9))):
                before, after = r.randint(0, reach - 1), r.randint(gram, length)
                rows.append((group, i, r.randint(0, 1), r.choice([20, 30]), before, bytes(r.choices(b"ab\0", [6, 6, 1], k=before)) + b"t" * gram + bytes(r.choices(b"ab\0", [6, 6, 1], k=after - gram))))
        rows.sort(key=lambda x: (x[0], x[1], x[3]))
        lo, hi = (0, reach - 1) if turn % 2 else (3, 6)
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.binary()) + (() if turn % 2 else (pa.int32(),) * 2)
        given = rows if turn % 2 else [(*x, lo, hi) for x in rows]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*given), kinds)], [str(i) for i in range(len(kinds))])
        want = set()
        for group, i, key, at, before, text in rows:
            for b in range(lo, min(hi, before) + 1):
                same = [(x[1], x[3]) for x in rows if x[0] == group and b <= x[4] and x[5][x[4] - b : x[4] - b + length] == text[before - b : before - b + length]]
                if before - b + length <= len(text) and min(same) < (i, at):
                    want |= {(i, key, p) for p in range(at - b, at - b + length)}
        cut = r.randint(0, batch.num_rows)
        prefixfree.SORTED, old = r.choice([1, 40, 1 << 15]), prefixfree.SORTED
        got = {(i, k, p) for out in prefixfree._equal_windows(iter([batch.slice(0, cut), batch.slice(cut)]), length, gram) for i, k, lo_, hi_ in zip(*(c.to_pylist() for c in out.columns)) for p in range(lo_, hi_)}
        prefixfree.SORTED = old
        assert got == want


def test_released_shuffles_leave_no_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    kept = materialize(spark.range(20_000).repartition(7, "id"), "released", release=True)
    for _ in range(50):
        if files.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert files.getAllFiles().size() <= before
    assert kept.count() == 20_000
