"""Near copies of the pipeline against similarities of all pairs."""

import random
import re

import pytest

import corpus_pipeline
from foliomatch.llm import nearcopies

DOCS = "doc_id long, text string"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r, text, n):
    w = text.split()
    for at in r.sample(range(len(w)), n):
        w[at] = f"x{r.randrange(10**9)}"
    return " ".join(w)


def text(r, n):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def wanted(rows, least=0.8):
    """The least doc_id reachable for each row, by all pairs."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        out.setdefault(doc_id, set()).add(min(ids, default=None))
    return out


def test_copies_edited_to_four_fifths_go(spark):
    r, rows, at = random.Random(4), [], []
    for n in range(300):
        base = text(r, 300)
        copy = edited(r, base, r.choice([2, 3, 4, 5, 6]))
        rows += [(2 * n, base), (2 * n + 1, copy)]
        at.append(similarity(grams(base), grams(copy)))
    near = {n for n, s in enumerate(at) if 0.8 <= s <= 0.97}
    assert len(near) > 200 and min(at) < 0.85
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert {2 * n for n in range(300)} <= kept
    assert not {2 * n + 1 for n in range(300) if at[n] < 0.8} - kept
    assert sum(2 * n + 1 not in kept for n in near) >= 0.96 * len(near)


@pytest.mark.parametrize("tile,together", [(2048, 1024), (8, 6)])
def test_groups_are_those_of_all_pairs(spark, tile, together):
    r = random.Random(1)
    base, other = text(r, 250), text(r, 400)
    rows = [(i, edited(r, base, r.choice([1, 2, 3]))) for i in range(10, 40)] + [(i, edited(r, other, 2)) for i in range(40, 55)]
    rows += [(60, "a b c"), (61, "A  b\tc"), (62, "a b"), (63, ""), (64, None), (65, "  \n "), (None, base), (None, "only here"), (10, other), (10, other), (70, text(r, 30))]
    chain = [other]
    for i in range(8):  # each near the one before, the ends not near each other
        chain.append(edited(r, chain[-1], 6))
        rows.append((80 + i, chain[-1]))
    got = {}
    for x in nearcopies.near_copies(spark.createDataFrame(rows, DOCS), tile=tile, together=together).collect():
        got.setdefault(x.doc_id, set()).add(x.component_id)
    assert got == wanted(rows)
    assert nearcopies.near_copies(spark.createDataFrame([], DOCS)).collect() == []
