"""Counting the beginnings of words: by brute force, and what a worker holds meanwhile."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from foliomatch.llm import toxicity as tx


def _batch(texts):
    n = np.arange(len(texts))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(n % 2), pa.array(n % tx.FOLDS)], ["text", "toxic", "fold"])


def test_counts_by_brute_force():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(60)] + ["a" * 40, "a" * 41]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(25)] + [None, "", "1 2"]
    want = Counter()
    for i, text in enumerate(texts):
        held = {(w[:k], k) for w in tx.tokens(text) for k in range(tx.SHORTEST, min(len(w), tx.LONGEST) + 1)} | {(w, "own") for w in tx.tokens(text)}
        want.update((*x, f"{'ct'[i % 2]}{i % tx.FOLDS}") for x in held)
    out = tx._count_slice(_batch(texts))
    assert out.num_rows == len({k[:2] for k in want})
    got = {r["key"]: r for r in out.to_pylist()}
    for word in {w for t in texts for w in tx.tokens(t)}:
        keys, there = tx.word_keys([word])
        for column in np.flatnonzero(there[0]):
            name = (word, "own") if column == keys.shape[1] - 1 else (word[: column + tx.SHORTEST], column + tx.SHORTEST)
            row = got[keys[0, column]]
            assert {c: row[c] for c in tx.COUNT_NAMES[3:]} == {c: want[*name, c] for c in tx.COUNT_NAMES[3:]}


def test_memory_of_counts_does_not_grow_with_the_documents():
    words = [f"{a}{b}{c}{d}stem" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdefgh"]
    text, peaks = " ".join(words), []
    for n in (2, 60):
        batch = _batch([text] * n)
        held = batch["text"].nbytes
        tracemalloc.start()
        tx._count_slice(batch)
        # the texts as Python strings and a number for each word of each document are held as well
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * held - 4 * n * len(words))
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
