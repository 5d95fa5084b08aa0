"""The audit of beams: hot groups and self matches do not hide that other queries lose their links."""

import numpy as np

from foliomatch.llm import hnsw


class Lossy(hnsw.Graph):
    """A graph whose search finds, under a beam of 96, nothing but the query itself; hot queries read the whole shard."""

    def __init__(self, x):
        self.x = x

    def within(self, q, least, width):
        a, b = self.all_within(q, least)
        many = np.bincount(a, minlength=len(q))[a] >= hnsw.BEAM
        itself = np.einsum("ij,ij->i", q[a], self.x[b]) > 1 - 1e-7
        keep = many | itself | (width >= 96)
        return a[keep], b[keep]


def test_audit_sees_small_groups_beside_a_hot_one():
    r = np.random.default_rng(3)
    hot = r.normal(size=(1, 32)) + r.normal(size=(700, 32)) * 0.02
    small = np.repeat(r.normal(size=(30, 32)), 10, 0) + r.normal(size=(300, 32)) * 0.02
    x = hnsw._unit(np.concatenate([hot, small, r.normal(size=(500, 32))])).astype(np.float32)
    ids = np.arange(len(x))
    assert hnsw.audited_width(Lossy(x), ids, 0.95) == 96
    alone = hnsw._unit(r.normal(size=(300, 32))).astype(np.float32)
    assert hnsw.audited_width(Lossy(alone), ids[:300], 0.95) == hnsw.BEAM
