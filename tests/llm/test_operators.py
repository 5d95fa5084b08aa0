"""Each operator against a plain version of its definition, with the awkward cases in every table."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomatch.llm import common, hnsw, mixing, packing, prefixfree, sharding, simhash, tokens, topk, toxicity, urlfilter
from foliomatch.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, _rank int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, t, s in rows], DOCS)


def words(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) if r.random() < 0.7 else f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = words(1, 30_000)
ROWS = [
    (1, words(2, 120), "a"), (2, words(2, 120), "a"), (3, None, "b"), (4, "", None), (5, LONG, "a"), (None, words(3, 60), "a"),
    (6, words(2, 120) + " tail", "b"), (6, words(2, 120) + " tail", "b"), (7, "  odd \n\n white\tspace  x ", "b"), (8, words(4, 50) + ". " + words(2, 120)[30:400], "c"),
    (9, "Z" * 450, "c"), (10, "Straße Été, ça. naïve\nIl dit: \"non\"! 12 3", "c"), (11, words(5, 1), None),
]
EMPTY = []


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, _ in ROWS] + ["it's I'LL  don't", "a <|endoftext|> b", "x\x85 y", "ﬁ é ́b", "Σίσυφος ΣΑΣ", "\U0010ffffa b \U0010ffffc", "a\x1c b", "a,. b.. c,", "\n", " "]
    own = [np.frombuffer(x, "<u4").tolist() for x in common.ChunkEncoder(tokenizer_path(name), memo=50).encode(texts)]
    assert own == [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    assert common.ChunkEncoder(tokenizer_path(name)).encode([]) == []


@pytest.mark.parametrize("rows", [ROWS, EMPTY])
def test_token_store_round_trip(spark, tmp_path, rows):
    from tokenizers import Tokenizer

    path = str(tmp_path / "store")
    tokens.write_tokens(make(spark, rows), path, tokenizer_path(BYTE_BPE))
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_tokens(spark, path).orderBy("start").collect()]
    t = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    want = sorted((i if i is not None else -1, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, x, _ in rows)
    assert [(i if i is not None else -1, b) for i, _, _, b in got] == want
    assert [s for _, s, _, _ in got] == [sum(len(b) // 4 for _, b in want[:k]) for k in range(len(want))]
    if rows:
        some = tokens.read_tokens(spark, path, doc_ids=[10, 5]).collect()
        assert sorted(r.doc_id for r in some) == [5, 10]


def test_token_store_refuses_another_dictionary(spark, tmp_path):
    path = str(tmp_path / "store")
    tokens.write_tokens(make(spark, ROWS), path, tokenizer_path(BYTE_BPE))
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        tokens.read_tokens(spark, path)


@pytest.mark.parametrize("rows", [ROWS, EMPTY])
def test_packing(spark, rows):
    docs = make(spark, rows)
    out = packing.pack(packing.cut_pieces(docs, tokenizer_path(WORD_BPE), 64), 64).collect()
    assert len(out) == packing.cut_pieces(docs, tokenizer_path(WORD_BPE), 64).count()
    by = {}
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length <= 64
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    if rows:
        assert len(by) <= -(-sum(r.length for r in out) // 64) + 1
        again = packing.pack(packing.cut_pieces(docs, tokenizer_path(WORD_BPE), 64), 64).collect()
        key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.piece, r.sequence_id, r.offset)
        assert sorted(map(key, out)) == sorted(map(key, again))


def test_packing_solver_fills_gaps_exactly():
    r = np.random.default_rng(0)
    for n, mean in ((200, 300), (5000, 500), (3, 10)):
        length, count = np.unique(np.minimum(r.exponential(mean, n).astype(int) + 1, 2048), return_counts=True)
        patterns = packing.solve(dict(zip(length.tolist(), count.tolist())), 2048)
        used = {}
        for parts, times in patterns:
            assert sum(parts) <= 2048
            for x in parts:
                used[x] = used.get(x, 0) + times
        assert used == dict(zip(length.tolist(), count.tolist()))
        assert sum(t for _, t in patterns) <= -(-int((length * count).sum()) // 2048) + 1
    with pytest.raises(KeyError):
        packing.place([])[1]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("rows", [ROWS + [(20 + i, words(50, 90) + " " + words(100 + i, 1), "a") for i in range(12)], EMPTY])
def test_simhash(spark, rows):
    got = simhash.simhash_components(make(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [brute_fingerprint(t) for _, t, _ in rows]
    label = components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    want = []
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((str(doc_id), fp[i], str(min(ids) if ids else None)))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == sorted(want)


def test_simhash_long_lists_are_tiled(spark):
    r = random.Random(0)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        fps.add(base ^ sum(1 << r.randrange(64) for _ in range(3)) & ((1 << 64) - 1))
    fps = [x - (1 << 64) if x >> 63 else x for x in fps] + [1, 2, 77777777]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(e.a, e.b) for e in simhash.near_fingerprints(df, tile=16).collect()]
    label = components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 4)
    at = {x: i for i, x in enumerate(fps)}
    pairs = {(at[a], at[b]) for a, b in edges}
    assert components(len(fps), lambda i, j: (i, j) in pairs or (j, i) in pairs) == label


def test_position_sets_cover():
    from itertools import combinations

    for bits in (1, 2, 3, 4, 5):
        sets = simhash.position_sets(bits)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 8 - bits))
    assert len(simhash.position_sets(4)) == 20


VECTORS = "vec_id long, embedding array<float>, label int, x string"


def vectors(spark, n=230, d=8, seed=0, odd=True):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d))
    v[n // 2 :] = v[: n - n // 2] + r.normal(size=(n - n // 2, d)) * 0.05
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, [float(x) for x in row], 0, "e") for i, row in enumerate(v)]
    if odd:
        rows += [(900, None, 0, "e"), (950, [0.0] * d, 1, "e"), (951, [float("nan")] * d, 1, "e"), (952, [None, 1.0], 1, "e"), (953, [], 1, "e"), (954, [0.5] * 3, 1, "e"), (955, [float("inf")] * d, None, "e")]
    return spark.createDataFrame(rows, VECTORS), rows


def usable(row):
    return row[1] is not None and len(row[1]) > 0 and all(x is not None and np.isfinite(x) for x in row[1])


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    df, rows = vectors(spark)
    clean = topk.clean_vectors(df)
    ints = clean.select("vec_id", topk.quantized(clean.x).alias("x"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id % 50 = 0"), 5).collect())
    q = {r[0]: np.floor(256 * np.array(r[1], np.float64)).astype(int) for r in rows if usable(r)}
    want = []
    for i in (k for k in q if k % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(ints.limit(0), ints.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_near_vectors(spark, seed):
    df, rows = vectors(spark, n=300, seed=seed)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()}
    assert len(got) == len(rows)
    v = [np.array(r[1], np.float64) if usable(r) and any(r[1]) else None for r in rows]
    cos = lambda i, j: v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= 0.95
    links = [sum(cos(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert sum(got[r[0]][0] for r in rows) >= 0.98 * sum(links)
    label = components(len(rows), cos)
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))}
    assert {k: c for k, (_, c, _) in got.items()} == want
    assert all(kept == (c == k) for k, (_, c, kept) in got.items())
    assert hnsw.near_vectors(df.limit(0)).collect() == []


def test_url_filter_as_of(spark):
    events = spark.createDataFrame(
        [("spam", "*.Bad.example", "add", "2024-01-10"), ("spam", "bad.example", "remove", "2024-02-01 12:00:00"), ("spam", "bad.example", "add", "2024-03-01"), ("adult", "x.bad.example", "add", "2024-01-15"),
         ("spam", "same.example", "add", "2024-01-01"), ("spam", "same.example", "remove", "2024-01-01"), (None, "z", "add", "2024-01-01"), ("spam", None, "add", "2024-01-01"), ("spam", "y", "other", "2024-01-01"), ("spam", "y.example", "add", None),
         ("adult", "day.example", "add", "2024-05-01 18:00:00"), ("spam", "day.example", "add", "2024-05-01 20:00:00"), ("adult", "day.example", "remove", "2024-05-01 21:00:00"), ("spam", "[2001:db8::1]", "add", "2024-01-01"), ("spam", "2.3.4", "add", "2024-01-01")],
        "list string, pattern string, action string, at string",
    )
    cases = [
        ("https://x.bad.example/p?q", "2024-01-09", 0, ""), ("http://user@www.x.BAD.example:80/", "2024-01-20", 2, "adult,spam"), ("https://bad.example", "2024-02-01 11:59:59", 1, "spam"), ("https://bad.example", "2024-02-01 12:00:00", 0, ""),
        ("https://a.x.bad.example", "2024-03-01", 2, "adult,spam"), (None, "2024-01-20", 0, ""), ("not a url", "2024-01-20", 0, ""), ("https://same.example", "2024-01-05", 0, ""), ("https://bad.example", None, 0, ""),
        ("https://bad.example", "2024-01-31", 1, "spam"), ("https://bad.example", "2024-01-31", 1, "spam"), ("https://day.example", "2024-05-01 09:00:00", 0, ""), ("https://day.example", "2024-05-01 18:00:00", 1, "adult"),
        ("https://day.example", "2024-05-01 20:30:00", 2, "adult,spam"), ("https://day.example", "2024-05-01 21:00:00", 1, "spam"), ("https://day.example", "2024-05-02", 1, "spam"),
        ("http://[2001:DB8::1]:8080/x", "2024-01-20", 1, "spam"), ("http://1.2.3.4/", "2024-01-20", 0, ""), ("http://b%61d.example/", "2024-01-20", 1, "spam"), ("https://x.bad.example/" + "a" * 300_000, "2024-01-20", 2, "adult,spam"),
    ]
    df = spark.createDataFrame([(i, *c[:2], "own", 7) for i, c in enumerate(cases)], "page_id long, url string, fetched_on string, host string, _at int")
    rows = urlfilter.filter_urls(df, events).collect()
    assert sorted((r.page_id, r.n_entries, r.lists, r.blocked, r._at) for r in rows) == [(i, n, lists, n > 0, 7) for i, (_, _, n, lists) in enumerate(cases)]
    assert {r.host for r in rows if r.page_id in (0, 5)} == {"x.bad.example", ""}
    assert urlfilter.filter_urls(df.limit(0), events).collect() == []
    assert not any(r.blocked for r in urlfilter.filter_urls(df, events.limit(0)).collect())


def test_url_verdicts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    events = spark.createDataFrame([("spam", "a.example", "add", "2024-01-02")], "list string, pattern string, action string, at string")
    df = spark.createDataFrame([(i, "https://a.example", f"2024-01-0{i}") for i in (1, 2, 3)], "page_id long, url string, fetched_on string")
    assert sorted((r.page_id, r.blocked) for r in urlfilter.filter_urls(df, events).collect()) == [(1, False), (2, True), (3, True)]


def brute_segments(s, lo=0, hi=None):
    """The best subrange, and those of what lies to its left and right: the definition of all maximal segments."""
    hi = len(s) if hi is None else hi
    upto = np.concatenate([[0.0], np.cumsum(s)])
    best = max(((upto[b] - upto[a], a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    return brute_segments(s, lo, best[1]) + [best[1:]] + brute_segments(s, best[2], hi)


def test_all_maximal_segments():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 24)
        s = [-0.3 if r.random() < 0.4 else r.uniform(-2, 2) for _ in range(n)]
        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x != -0.3], n)
        assert [(a, b) for a, b, _ in got] == brute_segments(s)
        assert all(x == pytest.approx(sum(s[a:b])) for a, b, x in got)


def test_segments_are_found_in_linear_time():
    import time

    falls = [x for i in range(100_000) for x in ((2 * i, 1.0), (2 * i + 1, -1.5))]
    start = time.process_time()
    assert len(toxicity.segments(falls, 200_000)) == 100_000
    assert time.process_time() - start < 5


def test_toxicity_on_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")  # 3,000 labelled documents; a tenth of them knows too few word families of three languages
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.repartition(4), labels)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id")))
    rows = scored.where("held").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) > 50
    assert np.mean([(r.score >= 0.3) == bool(r.toxic) for r in rows]) >= 0.98
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) >= 0.9 and hit / sum(r.score >= 0.3 for r in rows) >= 0.9
    odd = toxicity.score_toxicity(make(spark, ROWS), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.3 for r in toxicity.score_toxicity(docs.limit(5), none).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_fit_is_the_definition(spark):
    """Word scores and the constants of the law, against plain recursion over the parts of a small labelled table."""
    r = random.Random(8)
    pool = ["grumpal" + e for e in ("a", "en", "ung", "os")] + ["plain", "word", "a", "b", "Ⅷ", "ß", "z" * 70, "zz"] + [words(i, 1) for i in range(30)]
    rows = [(i, " ".join(r.choice(pool[:4] + pool if i % 5 == 0 or i % 11 == 1 and r.random() < 0.1 else pool[4:]) for _ in range(r.randint(1, 30))), int(i % 5 == 0)) for i in range(120)]
    rows += [(500, None, 0), (501, "", 1), (502, "12 ½ !", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    fitted = [(t, x, i) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    fold = {x.doc_id: x.h for x in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(toxicity.FOLDS)).alias("h")).collect()}

    def plain(part):
        found = [(set(re.findall(r"[^\W\d_]+", (t or "").lower())), x) for t, x, _ in part]
        share = (sum(x for _, x in found) + 1) / (len(found) + 2)

        def theta(prefix, whole):
            held = lambda p, whole: [i for i, (w, _) in enumerate(found) if any(y == p if whole else y.startswith(p) for y in w)]
            shorter = prefix[:32] if whole and len(prefix) >= 2 else prefix[:-1] if not whole and len(prefix) > 2 else None
            up = share if shorter is None else theta(shorter, False)
            if shorter is not None and held(prefix, whole) == held(shorter, False):
                return up
            own = [found[i][1] for i in held(prefix, whole)]
            return (sum(own) + toxicity.PRIOR * up) / (len(own) + toxicity.PRIOR)

        return lambda word: math.log(theta(word, True) / (1 - theta(word, True))) - math.log(share / (1 - share)) + toxicity.DRIFT

    model = toxicity.fit(docs, labels)
    score = plain(fitted)
    for w in pool + ["grumpalissimo", "zebra", "unseen"]:
        for w in re.findall(r"[^\W\d_]+", w.lower()):
            assert model.lexicon.score(w) == pytest.approx(score(w), abs=1e-5)
    others = [plain([f for f in fitted if fold[f[2]] != h]) for h in range(toxicity.FOLDS)]
    clean = [[others[fold[i]](w) for w in re.findall(r"[^\W\d_]+", (t or "").lower())] for t, x, i in fitted if not x]
    flat = [round(s, 1) for c in clean for s in c]
    assert sum(math.exp(model.rate * s) for s in flat) / len(flat) == pytest.approx(1, abs=0.02)
    best = [max((sum(c[a:b]) for a, b in brute_segments(c)), default=0.0) for c in clean if c]
    assert model.size == pytest.approx(math.exp(model.rate * np.mean(best) - 0.5772 - np.mean([math.log(len(c)) for c in clean if c])), rel=1e-6)


def test_law_of_labels():
    """Newton's method ends at the greatest likelihood, also where evidence is very large."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.uniform(0, 5, 300), [900.0]])
    y = (r.random(301) < 1 / (1 + np.exp(3 - 1.3 * np.minimum(x, 50)))).astype(float)
    slope, shift = toxicity._logistic(x, y)
    loss = lambda a, b: np.logaddexp(0, -np.where(y == 1, 1, -1) * (a * x + b)).sum()
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 0.1 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_top_k_stops_before_the_lists_end(spark, sf):
    """On the given vectors most queries leave a part of every list unread, and rows that are left out cannot qualify."""
    rows = topk.clean_vectors(spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")).select("vec_id", topk.quantized(F.col("x")).alias("x")).collect()
    v, ids = np.array([r.x for r in rows]), np.array([r.vec_id for r in rows])
    lists = topk.Lists(v, ids)
    shares = []
    for i in range(0, len(v), 40):
        left, share = lists.best(v[i], ids[i], 5)
        score = v @ v[i]
        score[i] = -(1 << 60)
        want = np.lexsort((ids, -score))[:5]
        assert set(want) <= set(left.tolist()) and len(left) <= len(v) / 4
        shares.append(share)
    assert np.median(shares) < 0.95 and np.mean(np.array(shares) < 1) > 0.8
    few = np.zeros(v.shape[1], np.int64)
    few[:3] = 200, -90, 150
    assert lists.best(few, -1, 5)[1] < 0.5


def targets(sizes):
    """Share by weight again and again until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        rest = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = ROWS + [(100 + i, words(i, 5 + i % 40), "abcdefgh"[i % 8] if i % 8 < 7 else None) for i in range(160)] + [(400 + i, words(i, 3), "tiny") for i in range(2)]
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"text", "_rank", "lang"}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        largest = max(int(r.taken / r.epochs) if r.epochs else 0 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(largest, 1)
        assert all(r.epochs <= 3 for r in mine)
        assert max((r.epochs for r in mine), default=0) - min((r.epochs for r in mine), default=0) <= 1
    slim = mixing.mix(make(spark, rows), slim=True).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, slim)) == sorted(map(key, got))
    assert mixing.mixed(make(spark, rows)).count() == sum(r.epochs for r in got)
    assert mixing.mix(make(spark, EMPTY)).collect() == []


def test_mixing_prefers_quality(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("#1$2 " * 20), "s" if i < 400 else "t") for i in range(800)]
    got = [r for r in mixing.mix(make(spark, rows)).collect() if r.source == "t"]
    share = lambda odd: np.mean([r.epochs for r in got if r.doc_id % 2 == odd])
    assert share(1) > share(0)


def test_mixing_cuts_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 8)
    rows = [(i, words(i, 3 + i % 20), "st"[i % 5 == 0]) for i in range(400)] + [(7, words(7, 10), "s")] * 3
    key = lambda out: sorted((r.doc_id, r["size"], r.source, r.taken) for r in out.collect())
    light = F.lit(0.01)
    plain = key(mixing.mix(make(spark, rows), weight=light))
    monkeypatch.setattr(mixing, "BORDER_ROWS", 3)
    assert key(mixing.mix(make(spark, rows), weight=light)) == plain


def test_sharding(spark):
    rows = ROWS + [(100 + i, words(i, 5 + i % 90), "a") for i in range(150)]
    got = sharding.shard_by_bytes(make(spark, rows), 4).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for s in range(4):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in order)))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] >= 1 for r in got)
    small = sharding.shard_by_bytes(make(spark, [r for r in rows if r[0] != 5]), 4).collect()
    total = sum(int(r["size"]) for r in small)
    for s in range(4):
        assert abs(sum(int(r["size"]) for r in small if r.shard == s) - total / 4) <= max(int(r["size"]) for r in small)
    assert sharding.shard_by_bytes(make(spark, EMPTY), 4).collect() == []


CLASH = "row string, key string, h string, length2 long, _key int, _cell int, _s int, _b int, _r int, _rows int, _range int, shard int, offset long, sequence_id long, score double, spans int, kept int, size string"


def clashing(spark, rows):
    extra = ("r", "k", "h", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0.5, 12, 13, "s")
    return spark.createDataFrame([(i, t, "en", s, 0, *extra) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def test_columns_of_any_name_stay(spark):
    docs = clashing(spark, ROWS)
    for out, own in ((mixing.mix(docs), mixing.RESULTS), (sharding.shard_by_bytes(docs, 4), sharding.RESULTS)):
        assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(r[c] == w[c] for r, w in zip(rows, [docs.first()] * len(rows)) for c in CLASH.replace(",", "").split()[::2] if c not in own)
    pieces = docs.select("*", F.lit(5).alias("length"), F.lit(0).alias("piece"))
    packed = packing.pack(pieces, 16)
    assert sorted(packed.columns) == sorted(pieces.columns) and packed.where("h = 'h' AND _key = 2 AND row = 'r'").count() == len(ROWS)
    assert {r.offset for r in packed.collect()} == {0, 5, 10}
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("length", F.lit(17)), 16)
    assert mixing.mixed(docs).columns == docs.columns
    scored = toxicity.score_toxicity(docs, toxicity.Model({}), keep=tuple(docs.columns))
    assert len(set(scored.columns)) == len(scored.columns) and scored.where("score < 0.5 AND _key = 2").count() == len(ROWS)


def test_token_store_checks_widths_and_orders_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    with pytest.raises(ValueError):
        tokens.write_tokens(make(spark, ROWS), str(tmp_path / "bad"), tokenizer_path(BYTE_BPE), end_id=1 << 17)
    with pytest.raises(ValueError):
        tokens.write_tokens(make(spark, ROWS), str(tmp_path / "bad"), tokenizer_path(BYTE_BPE), id_bytes=1)
    path = str(tmp_path / "store")
    tokens.write_tokens(make(spark, [(i * 37 % 1009, f"text {i}", "a") for i in range(1009)]), path, tokenizer_path(BYTE_BPE))
    files = sorted(glob.glob(f"{path}/blocks/*.parquet"))
    ids = [i for f in files for row in pq.read_table(f).to_pylist() for i in row["doc_ids"]]
    assert ids == sorted(ids) and len(ids) == 1009 and len(files) > 1


def test_repeated_and_missing_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in hnsw.near_vectors(df).collect())
    assert got == sorted([("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 1, "1", False), ("3", 1, "1", False), ("None", 0, "None", True), ("9", 0, "9", True)])


def test_top_k_ties_repeats_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 4)
    rows = [(i, [3, 1]) for i in range(1, 30)] + [(50, [1, 0]), (50, [0, 9]), (None, [99, 99]), (7, [3, 1])]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1)] or got == [(1, 1, 9), (2, 2, 9), (3, 3, 9), (4, 4, 9), (5, 5, 9)]
    big = spark.createDataFrame([(0, [1e38, 1.0]), (1, [1e38, 2.0]), (2, [1e30, 0.0]), (3, [-1e38, 0.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    clean = topk.clean_vectors(big)
    ints = clean.select("vec_id", topk.quantized(clean.x).alias("x"))
    top = [(r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id = 0"), 5).orderBy("rank").collect()]
    most = (1 << 63) - 1
    assert top == [(1, most), (2, most), (4, most), (3, -(1 << 63))]


def test_top_k_reads_on_until_outsiders_cannot_qualify():
    r = np.random.default_rng(5)
    for n, d, k in ((900, 6, 5), (40, 3, 50), (500, 64, 3)):
        v = np.floor(256 * r.normal(size=(n, d))).astype(np.int64)
        ids = np.arange(n)
        got = topk.search(v, ids, v[::90], ids[::90], k)
        want = []
        for i in ids[::90].tolist():
            score = v @ v[i]
            want += [(i, int(j), int(score[j])) for j in sorted((j for j in ids if j != i), key=lambda j: (-score[j], j))[:k]]
        assert got == want


def test_registered_forms_on_a_small_table(spark, tmp_path):
    """The columns that the queries derive from their operators, each worked out again from the texts alone."""
    from tokenizers import Tokenizer

    from foliomatch.llm import queries

    make(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    texts = sorted(((i if i is not None else -1), t or "") for i, t, _ in ROWS)
    num = lambda i: -1 if i is None else i

    def ids(name, text, end):
        return np.array(Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids + [end], "<u4").tobytes()

    start, want = 0, []
    for i, t in texts:
        x = ids(BYTE_BPE, t, 2)
        want.append((i, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    assert sorted((num(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in run("op1_token_binary")) == want
    want = []
    for i, t in texts:
        x = ids(WORD_BPE, t, 0)
        want += [(i, p, at // 4, len(x[at : at + 8192]) // 4, zlib.crc32(x[at : at + 8192])) for p, at in enumerate(range(0, len(x), 8192))]
    assert sorted((num(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in run("op2_best_fit_packing")) == want
    assert sorted((num(r.doc_id), r.fingerprint) for r in run("op3_simhash_near_dedup")) == [(i, f"{brute_fingerprint(t):016x}") for i, t in texts]
    got = run("op10_substring_dedup")
    assert sorted((num(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == brute_spans(ROWS, 100)
    assert all((r.n_spans > 0) == (r.n_removed > 0) for r in got)
    got = run("op9_contiguous_shards")
    assert sorted((num(r.doc_id), r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == [(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in texts]
    spark.createDataFrame([(1, 0, 1), (2, 0, 0), (5, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = run("op7_toxicity")
    assert len(got) == len(ROWS) and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_cut_characters_go_whole(spark):
    shared = "ä€𐍈" * 30
    rows = [(1, "x" + shared + "1", "a"), (2, "\u2028" + shared + "é", "a"), (3, "\ufffd" + shared[1:] + "\ufffd", "a"), (4, "ö" + shared[1:], "a")]
    for r in prefixfree.dedup_substrings(make(spark, rows), characters=True).collect():
        assert "\ufffd" not in bytes(r.kept).decode() or r.doc_id == 3
        assert bytes(r.kept).decode() == "".join(c for c in bytes(r.kept).decode() if r.doc_id != 2 or c in "\u2028é")


def brute_spans(rows, length):
    """Covered bytes by looking every window up among all that start earlier."""
    first = {}
    texts = [((i if i is not None else -1), (t or "").encode()) for i, t, _ in rows]
    for i, b in sorted(set(texts)):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, b in texts:
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                hit[p : p + length] = True
        out.append((i, len(b), int(hit.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram", [(100, 24), (30, 8)])
def test_substring_dedup(spark, length, gram, monkeypatch):
    r = random.Random(9)
    shared = words(77, 60)
    rows = ROWS + [(50 + i, words(200 + i, r.randint(3, 60)) + " " + shared[r.randint(0, 40) : r.randint(150, 380)] + " " + words(300 + i, 4), "a") for i in range(40)]
    rows += [(30, "ab" * 300, "a"), (31, "ü" * 90 + "ab" * 120, "a"), (99, "\0" * 250, "b")]
    monkeypatch.setattr(prefixfree, "TOGETHER", 6)
    got = prefixfree.dedup_substrings(make(spark, rows), length, gram, columns=("lang", "_rank")).collect()
    mine = sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, sum(s.hi - s.lo for s in x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got)
    assert mine == brute_spans(rows, length)
    assert all(a.hi < b.lo for x in got for a, b in zip(x.spans, x.spans[1:]))
    assert prefixfree.dedup_substrings(make(spark, EMPTY), length, gram).collect() == []


def test_triggers_do_not_depend_on_segments(monkeypatch):
    text = (words(5, 4000) + "a" * 3000 + words(6, 500)).encode()
    whole = prefixfree.triggers(text)
    monkeypatch.setattr(prefixfree, "SEGMENT", 1 << 10)
    cut = prefixfree.triggers(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
