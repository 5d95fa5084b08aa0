"""The pipeline stage by stage against brute force, and its bookkeeping."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliomatch.llm import nearcopies, queries, toxicity
from tests.llm.test_operators import brute_segments, components, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CURSES = "vile scum filth rotten wretch".split()


def corpus():
    """Near copies of many degrees, shared passages, toxic and clean texts, and the awkward rows."""
    r = random.Random(11)
    rows, i = [], 0

    def add(text, source=None):
        nonlocal i
        i += 1
        rows.append((i, text, "en", source or "abc"[i % 3], len(text or "")))

    passage = " ".join(words(900, 70).split()) + " §é "
    for k in range(30):
        base = words(1000 + k, 110).split()
        add(" ".join(base))
        for edits in (0, 1, 2, 6, 20):
            if (k + edits) % 3 == 0:
                copy = list(base)
                for at in r.sample(range(len(copy)), edits):
                    copy[at] = f"edit{i}x{at}"
                add(" ".join(copy))
    for k in range(12):
        add(words(2000 + k, 40) + " " + passage[k : 300 + 5 * k] + words(2100 + k, 30))
    for k in range(40):
        add(" ".join(r.choice(CURSES) if r.random() < 0.25 else w for w in words(3000 + k, 80).split()) if k % 2 else words(3000 + k, 80))
    add(words(4000, 9000))
    add(None)
    add("")
    add("   \n ")
    rows += [(9000, words(5000, 90), None, None, None)] * 2 + [(None, words(5001, 90), "en", "a", 0)]
    labels = [(row[0], 0, int(any(c in (row[1] or "").split() for c in CURSES))) for row in rows if row[0] is not None]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before each stage and after it, over a small corpus."""
    rows, labels = corpus()
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{where}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, where), "test")
        out[name] = docs.collect(), after.collect()
        docs = after
    return where, out


def keyed(rows):
    return sorted(tuple("\0" if x is None else str(x) for x in r) for r in rows)


def test_toxic_documents_go(spark, stages):
    where, out = stages
    before, after = out["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))

    def score(text):
        tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
        s = [model.lexicon.score(w) for w in tokens]
        sums = sorted((sum(s[a:b]) for a, b in brute_segments(s)), reverse=True) if any(x > 0 for x in s) else []
        if not sums:
            return model.probability(0.0)
        pooled = sums[0] + sum(max(0.0, x - math.log(k + 1)) for k, x in enumerate(sums[1:], 1))
        return model.probability(max(0.0, model.rate * pooled - math.log(model.size * max(len(s), 1))))

    short = [r for r in before if len(r.text or "") < 20_000]
    assert keyed(r for r in after if len(r.text or "") < 20_000) == keyed(r for r in short if score(r.text) < corpus_pipeline.TOXIC)
    cursed = [r for r in before if any(c in (r.text or "").split() for c in CURSES)]
    assert len(cursed) == 20 and not {r.doc_id for r in cursed} & {r.doc_id for r in after}
    assert len(before) - len(after) == 20


def test_near_copies_go(stages):
    before, after = stages[1]["simhash_near_dedup"]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ((r.text or "").encode().lower().split() for r in before)]
    near = lambda i, j: (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    label = components(len(before), near)
    least = {x: min((r.doc_id for r, y in zip(before, label) if y == x and r.doc_id is not None), default=None) for x in set(label)}
    want = [r for r, x in zip(before, label) if r.doc_id is None or r.doc_id == least[x]]
    assert keyed(after) == keyed(want) and len(want) < len(before)
    kept = [nearcopies.shingles(r.text) for r in after]
    assert all(len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) for i, a in enumerate(kept) for b in kept[:i] if len(a) and a is not b and not np.array_equal(a, b))


def test_repeats_go(stages):
    before, after = stages[1]["substring_dedup"]
    length, first = 100, {}
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    for r in sorted(set(before), key=order):
        raw = (r.text or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (order(r), p))
    want = []
    for r in before:
        raw = (r.text or "").encode()
        hit = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (order(r), p):
                hit[p : p + length] = True
        at, text = 0, []
        for c in r.text or "":
            n = len(c.encode())
            text.append("" if hit[at : at + n].any() else c)
            at += n
        if not hit.any():
            want.append(tuple(r))
        elif "".join(text).strip(" "):
            want.append((r.doc_id, "".join(text), r.lang, r.source, len("".join(text))))
    assert keyed(after) == keyed(want) and any(r.text is None for r in after)
    assert sum(len(r.text or "") for r in after) < sum(len(r.text or "") for r in before)


def test_sources_are_mixed(stages):
    before, after = stages[1]["mix_sources"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in before])
    taken = con.execute(queries.OP8_SQL).fetchall()
    epochs = {}
    for doc_id, size, _, _, n in taken:
        if size:
            epochs[str(doc_id)] = n // size
    got = {}
    for r in after:
        if (r.text or "").split():
            got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + 1
    twice = [str(r.doc_id) for r in before]
    unique = {k for k in epochs if twice.count(k) == 1}
    assert {k: v for k, v in got.items() if k in unique} == {k: v for k, v in epochs.items() if k in unique and v}
    assert set(keyed(after)) <= set(keyed(before))


def test_pieces_are_packed(stages):
    from tokenizers import Tokenizer

    before, after = stages[1]["best_fit_packing"]
    encode = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE)).encode
    want = []
    for r in before:
        x = np.array(encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(r.doc_id), at // 2048, at, x[at : at + 2048].tobytes()) for at in range(0, len(x), 2048)]
    assert sorted((str(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in after) == sorted(want)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in after)
    by = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(by) <= -(-sum(r.length for r in after) // 2048) + 1


def test_columns_of_any_name_pass_through(spark, stages):
    docs = spark.read.parquet(f"{stages[0]}/documents.parquet").limit(40)
    docs = docs.select("*", *[F.lit(n).alias(n) for n in ("score", "row", "spans", "kept", "_id", "_key", "left", "cut", "key", "size", "epochs", "component_id", "n", "h")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, stages[0])
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in docs.columns[5:]), name


def test_stages_chain(spark, sf):
    sf = sf.replace("0.001", "0.01")  # enough labels to fit on
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mix_sources", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs, "test")
        seen[name] = docs.count()
    assert n > seen["toxicity"] > seen["simhash_near_dedup"] >= seen["substring_dedup"] > 0
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1")
    assert docs.join(toxic, "doc_id", "left_semi").count() <= 0.2 * toxic.count() + 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    by = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in by) <= 2048
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_registered_names():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
