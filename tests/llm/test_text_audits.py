"""Byte-level BPE against the public library, the divergence of sources and the audit of filters against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomatch.llm import bytebpe, divergence, filteraudit
from foliomatch.llm.queries import MULTI_BPE, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n string, _id int, _word string, part string, ids int, rank int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 1, "y", "z", 2, 3) for i, t, g, s in rows], DOCS)


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["Der", "straße", "the", "THE", "x1y", "É", "été", "a_b", "漢字", "I'll", "won#t", "z" * r.randint(1, 30)]) for _ in range(n))


ROWS = [
    (1, text(1, 80), "en", "a"), (2, text(1, 80), "en", "b"), (2, text(1, 80), "en", "b"), (3, None, "en", "c"), (4, "", None, None), (5, text(2, 4000), "en", "a"),
    (None, text(3, 60), "de", "a"), (None, text(3, 60), "de", "b"), (6, text(1, 80), "", ""), (7, "  odd \n\n\twhite\x0b space  ", "de", "b"), (8, "ABC DEF & x | y", "fr", "a"),
    (9, "\x1c\x85 \x00nul\x00  é", "de", None), (10, "the the the the", "en", "a"), (11, text(4, 51), "en", "b"), (-(1 << 63), text(3, 60), "de", "d"), (12, "...", "fr", "b"),
]
#: a third of all rows are copies of one row, another third has one text and no id
HOT = ROWS + [ROWS[0]] * 40 + [(None, "same words here again", "en", "a")] * 40 + [(100 + i, "same words here again", "en", "hot") for i in range(40)]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bytebpe.load_ranks(tokenizer_path(MULTI_BPE))
    return public_tokenizers.PATTERN, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(library):
    return bytebpe.TextEncoder(library[1], library[0])


def test_bpe_is_the_library(library, encoder):
    r = random.Random(0)
    alphabets = ["ab", "aeiounrst ", "aàéßñ漢字かなЖйЁ😀", "'s.,-–\n\t 12xyzABC\x00\x85 "]
    texts = [t or "" for _, t, _, _ in ROWS] + ["<|endoftext|> x", "a" * 30_000, "é" * 999]
    texts += ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 80))) for _ in range(500)]
    texts += ["".join(r.choice(a) for _ in range(r.randint(0, 200))) for a in alphabets for _ in range(200)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library[2].encode_ordinary(t), t


def test_bpe_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bytebpe, "MEMO_PAIRS", 3)
    own = bytebpe.TextEncoder(library[1], library[0])
    for t in ("unbelievable words of several pieces", "unbelievable words again"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library[2].encode_ordinary(t)
    assert len(own.memo) <= 3 and len(own.pieces.pairs) <= 3


@pytest.mark.parametrize("seed", range(30))
def test_bpe_of_small_vocabularies(seed):
    """Random merges over three letters, some vocabularies with tokens whose parts come later or that merging never makes."""
    r = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 256 + 25:
        pool = [t for t in tokens[97:100] + tokens[256:] if len(t) < 5]
        new = r.choice(pool) + r.choice(pool)
        if new not in tokens:
            tokens.append(new)
    if seed % 3 == 0:
        tokens[256:] = r.sample(tokens[256:], 25)
    ranks = {t: i for i, t in enumerate(tokens)}
    own = bytebpe.BytePieceEncoder(ranks)
    for _ in range(300):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in bytebpe.merge_by_rank(piece, ranks)]
        assert own.encode(piece) == want


@pytest.mark.parametrize("rows", [ROWS, HOT, []])
def test_bpe_round_trip(spark, library, rows):
    path = tokenizer_path(MULTI_BPE)
    out = bytebpe.decode_ids(bytebpe.encode_texts(make(spark, rows), path, library[0]), path)
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded), r.k) for r in out.withColumn("k", bytebpe.n_ids(F.col("ids"))).collect())
    ids = [library[2].encode_ordinary(t or "") for _, t, _, _ in rows]
    assert got == Counter((i, np.array(x, "<u4").tobytes(), (t or "").encode(), len(x)) for (i, t, _, _), x in zip(rows, ids))


def test_bpe_decoding_refuses_other_ids(spark):
    path = tokenizer_path(MULTI_BPE)
    bad = spark.createDataFrame([(bytearray(np.array([7, 60_000], "<u4").tobytes()), 1)], "ids binary, `odd name` int")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytebpe.decode_ids(bad, path).collect()
    none = spark.createDataFrame([(None, 1)], "ids binary, `odd name` int")
    assert bytebpe.decode_ids(none, path).collect()[0].decoded is None


# divergence of sources


def plain_divergence(rows, least=3, top=200):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        seen = Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in seen.items() if n >= least]
        count = {s: Counter() for s, _ in own}
        for s, w in own:
            count[s].update(w)
        every = sum(count.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, whole = {s: shares(c) for s, c in count.items()}, shares(every)
        f = lambda x, y: (x - y) ** 2 // y
        for s in p:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            term = [(t, f(p[s][t], whole[t])) for t in kept if count[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


MANY = [(i, text(i, 60 + i) + " " + " ".join(f"w{chr(97 + i % 7)}{chr(97 + j % 26)}q" for j in range(i)), "en", f"s{i % 5}") for i in range(40)]


@pytest.mark.parametrize("rows", [ROWS, HOT, MANY, []], ids=["odd", "hot", "many", "none"])
def test_divergence(spark, rows):
    for top in (200, 3):
        got = [tuple(r) for r in divergence.audit_sources(make(spark, rows).repartition(3), terms=top).collect()]
        assert sorted(got) == plain_divergence(rows, top=top)


def test_joint_histograms_hold_every_term(spark):
    kept = divergence.kept_terms(make(spark, MANY))
    _, groups = divergence._groups(make(spark, MANY), kept)
    v = groups.first().v
    cells = divergence.joint_histograms(kept, groups)
    assert cells.where("m < 0").count() == 0
    assert {r["sum(m)"] for r in cells.groupBy("a", "b").sum("m").collect()} == {v}


def test_shares_of_large_counts(spark):
    n = 4_000_000_000_000
    rows = spark.createDataFrame([(n, 3 * n, 5)], "c long, t long, v long")
    assert rows.select(divergence._share("c", "t")).first()[0] == 1 + 10**9 * (n + 1) // (3 * n + 5)


# filters


def plain_audit(rows, labels):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    docs = []
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        docs.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    shapley = Counter()
    for part in {d[0] for d in docs}:
        for order in orders:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                cut = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                unique = sum(d[1] == {f} for d in docs if d[0] == part)
                out[part, order, step] = [len(left), len(cut), sum(f in d[1] for d in gone), unique, sum(d[2] for d in cut), sum(d[3] for d in cut)]
                shapley[part, f] += len(cut)
                gone += cut
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (8, None, 1), (None, 1, 1), (10, 1, 0), (105, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("rows", [ROWS, HOT, MANY, []], ids=["odd", "hot", "many", "none"])
def test_filter_audit(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns({"part": F.lit("x"), "n": F.lit(1)})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filteraudit.audit_filters(make(spark, rows).repartition(3), labels).collect()}
    assert got == plain_audit(rows, LABELS)


def test_word_counts_deal_texts_once(spark):
    """Both counts stay on the partitions that the texts were dealt to: one exchange below them, and one to join salts."""
    plan = filteraudit.word_counts(make(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_digests_of_the_query(spark, sf):
    from foliomatch.llm.queries import op11_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op11_byte_bpe(spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
