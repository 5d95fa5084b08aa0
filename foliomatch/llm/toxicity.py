"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomatch.llm.common import map_batches
from foliomatch.plans.stages import materialize

#: Labelled documents that a model is fitted on at most, and parts of them of which each is scored by the others.
FIT_DOCUMENTS, FOLDS = 20_000, 3
#: Documents that a token's prior weighs, first and last length of the beginnings that words share, what every token costs.
PRIOR, SHORTEST, LONGEST, DRIFT = 3.0, 2, 32, -1.5
#: E-value up to which a passage is reported, and words whose scores a worker remembers.
EVALUE, REMEMBERED = 0.01, 200_000
#: Words that are hashed together, each with as many keys as it has beginnings.
HASHED = 8192
RESULTS = ("n", "best", "evidence", "score", "passages")
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 4, is 2. Without an id it is kept."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def tokens(text: str | None) -> list[str]:
    """Words of letters in lower case; fitting and scoring see the same ones."""
    return WORD.findall((text or "").lower())


def segments(scores: list[tuple[int, float]], n: int, idle: float = -0.3) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of ``n`` tokens, by start.

    ``scores`` has the tokens (position, score) that differ from ``idle``, ascending.
    """
    values = np.full(n, idle)
    if scores:
        at, own = zip(*scores)
        values[list(at)] = own
    return _segments(values)


def _segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's algorithm in linear time: only tokens that score are visited, between the sums before and after them.

    Every open candidate links to the nearest one before it whose sum so far is lower, so a search skips what an earlier
    one has passed; where there is none, all open ones are closed.
    """
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = np.flatnonzero(values > 0)
    closed: list[list] = []
    found: list[list] = []  # start, end, sum before, sum after, link
    for i, before, total in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0:
                closed += found
                found = [[start, i + 1, before, total, -1]]
                break
            if found[j][3] >= total:
                found.append([start, i + 1, before, total, j])
                break
            start, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(x[0], x[1], x[3] - x[2]) for x in closed + found]


_K, _OWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's beginnings of ``SHORTEST`` to ``LONGEST`` letters and, in the last column, of the word itself.

    ``(keys (n, columns) long, there (n, columns) bool)``; a word has no beginning longer than itself. All words of a call
    are hashed together, letter by letter.
    """
    letters = np.array(words, f"<U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = LONGEST - SHORTEST + 1
    keys, there = np.zeros((len(words), n + 1), np.uint64), np.zeros((len(words), n + 1), bool)
    h = np.full(len(words), _K, np.uint64)
    for k in range(min(LONGEST, int(sizes.max(initial=0)))):
        on = sizes > k
        step = (h ^ letters[:, k]) * _K
        h = np.where(on, step ^ (step >> np.uint64(29)), h)
        if k + 1 >= SHORTEST:
            keys[:, k + 1 - SHORTEST], there[:, k + 1 - SHORTEST] = h, on
    for i in np.flatnonzero(sizes > LONGEST):
        h[i] ^= np.uint64(xxhash.xxh64_intdigest(words[i].encode()))
    own = (h ^ _OWN) * _K
    keys[:, n], there[:, n] = own ^ (own >> np.uint64(31)), True
    return (keys >> np.uint64(1)).astype(np.int64), there


class Lexicon:
    """Scores of words and of their beginnings, two-sided: log-odds of a toxic document against those of any.

    A beginning's share of toxic documents has a Dirichlet prior, with the weight of ``PRIOR`` documents, around the share of
    the beginning that is one letter shorter, and that of ``SHORTEST`` letters around the share of all documents; a word's
    own is around that of its longest beginning. So a rare word says what its family says. A beginning that stands in the
    same documents as the shorter one adds no evidence: its share is that one's, and it need not be kept to be scored.
    """

    def __init__(self, keys: np.ndarray | None = None, scores: np.ndarray | None = None):
        self.keys = np.empty(0, np.int64) if keys is None else keys
        self.scores = np.empty(0) if scores is None else scores

    @staticmethod
    def log_odds(above: np.ndarray, depths: np.ndarray, toxic: np.ndarray, every: np.ndarray, share: float) -> np.ndarray:
        """Log-odds from the documents, and the toxic ones, that hold each key; ``above`` is the place of the shorter one, or -1."""
        shares = np.empty(len(above))
        same = (above >= 0) & (every == every[above])
        for depth in np.unique(depths):
            here = np.flatnonzero(depths == depth)
            prior = np.where(above[here] < 0, share, shares[above[here]])
            shares[here] = np.where(same[here], prior, (toxic[here] + PRIOR * prior) / (every[here] + PRIOR))
        return np.log(shares / (1 - shares)) - math.log(share / (1 - share))

    def scores_of(self, words: list[str]) -> np.ndarray:
        """The score of each word, or of its longest beginning that is known, with the cost of every token; else the cost alone."""
        if not len(self.keys) or not words:
            return np.full(len(words), DRIFT)
        if len(words) > HASHED:
            return np.concatenate([self.scores_of(words[i : i + HASHED]) for i in range(0, len(words), HASHED)])
        mine, there = word_keys(words)
        at = np.zeros(mine.shape, np.int64)
        at[there] = np.minimum(np.searchsorted(self.keys, mine[there]), len(self.keys) - 1)
        known = there & (self.keys[at] == mine)
        longest = known.shape[1] - 1 - np.argmax(known[:, ::-1], axis=1)
        return DRIFT + np.where(known.any(1), self.scores[at[np.arange(len(words)), longest]], 0.0)

    def score(self, word: str) -> float:
        return float(self.scores_of([word])[0])


class Model:
    """Token scores, the extreme-value law of a clean document's best segment, and the map to a probability."""

    def __init__(self, lexicon: Lexicon | None = None, rate: float = 1.0, size: float = 0.1, slope: float = 1.0, shift: float = -3.0):
        self.lexicon, self.rate, self.size, self.slope, self.shift = lexicon or Lexicon(), rate, size, slope, shift
        self.known: dict[str, float] = {}

    def values(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The score of each word of each text; those of about ``REMEMBERED`` words are remembered.

        Words that are new are looked up together for about a million letters of texts.
        """
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < 1 << 20:
                parts.append(tokens(texts[at]))
                size += len(texts[at] or "")
                at += 1
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            new = list(set().union(*parts).difference(known))
            known.update(zip(new, self.lexicon.scores_of(new).tolist()))
            for words in parts:
                yield np.array(list(map(known.__getitem__, words)), float)

    def passages(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Number of tokens and all maximal segments of each text."""
        for values in self.values(texts):
            yield len(values), _segments(values)

    def bits(self, score: float, n: int) -> float:
        """-ln of the E-value of a segment in ``n`` tokens: rate * score - ln(size * n)."""
        return self.rate * score - math.log(self.size * max(n, 1))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """What all passages of a document say together: -ln of the E-value of their pooled sum, 0 without any.

        The segments are independent under the law, so the sum of their normalized scores is weighed once.
        """
        return max(0.0, self.bits(pooled(found), n)) if found else 0.0

    def probability(self, x: float) -> float:
        """Of the label, by the logarithm of one more than the evidence, as that of long abuse is without bound."""
        t = self.slope * math.log1p(x) + self.shift
        return 1.0 / (1.0 + math.exp(-t)) if t >= 0 else math.exp(t) / (1.0 + math.exp(t))


def pooled(found: list[tuple[int, int, float]]) -> float:
    """The best segment's score and what the others, by rank, have over the logarithm of their rank."""
    best = sorted((s for _, _, s in found), reverse=True)
    return best[0] + sum(max(0.0, s - math.log(i + 1)) for i, s in enumerate(best[1:], 1)) if best else 0.0


def sample_labels(labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """At most ``limit`` labelled documents that are not held out, by hash of doc_id: ``(doc_id, toxic int)``.

    A document labelled twice counts as toxic if one of its labels says so; rows without an id or a label do not count.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


COUNT_NAMES = ["key", "parent", "depth", *[f"{kind}{k}" for k in range(FOLDS) for kind in "ct"]]


def _count_slice(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Clean and toxic documents of each part that hold each beginning of a word.

    Beginnings are numbered once for the words of the slice and counted document by document, so that a worker holds the
    different ones and never those of all documents beside each other.
    """
    numbers: dict[str, int] = {}
    held = [np.array([numbers.setdefault(w, len(numbers)) for w in set(tokens(text))], np.int32) for text in batch["text"].to_pylist()]
    if not numbers:
        return None
    words, every, sizes = list(numbers), [], []
    for at in range(0, len(words), HASHED):
        keys, there = word_keys(words[at : at + HASHED])
        parents, depths = np.zeros_like(keys), np.broadcast_to(np.arange(keys.shape[1], dtype=np.int8), keys.shape)
        parents[:, 1:-1] = keys[:, :-2]
        last = there[:, :-1].sum(1) - 1  # the longest beginning of each word, or none
        parents[:, -1] = np.where(last >= 0, keys[np.arange(len(keys)), last], 0)
        every.append([x[there] for x in (keys, parents, depths)])
        sizes.append(there.sum(1))
    keys, parents, depths = map(np.concatenate, zip(*every))
    del every
    keys, first, own = np.unique(keys, return_index=True, return_inverse=True)
    parents, depths, own = parents[first], depths[first], own.astype(np.int32)
    ends = np.cumsum(np.concatenate(sizes))
    begins = ends - np.concatenate(sizes)
    counts = np.zeros((2 * FOLDS, len(keys)), np.int32)
    for mine, toxic, fold in zip(held, batch["toxic"].to_pylist(), batch["fold"].to_pylist()):
        n = ends[mine] - begins[mine]
        at = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts[2 * fold + toxic, np.unique(own[at])] += 1
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (keys, parents, depths, *counts)], COUNT_NAMES)


def lexicons(texts: DataFrame) -> list[Lexicon]:
    """From ``texts(text, toxic, fold)``: of all parts, then for each part that of the others. All share their keys.

    The sample is bounded, and so is what comes to the driver: a row of counts for each beginning of its words.
    """
    counted = map_batches(texts.select("text", "toxic", "fold"), _count_slice, ", ".join(f"{c} long" for c in COUNT_NAMES))
    sums = [F.min("parent").alias("parent"), F.min("depth").cast("byte").alias("depth")] + [F.sum(c).cast("int").alias(c) for c in COUNT_NAMES[3:]]
    got = counted.groupBy("key").agg(*sums).toArrow()
    order = np.argsort(got["key"].to_numpy())
    keys, parents, depths = (got[c].to_numpy()[order] for c in COUNT_NAMES[:3])
    above = np.where(parents == 0, -1, np.searchsorted(keys, parents)).astype(np.int32)
    counts = {c: got[c].to_numpy()[order] for c in COUNT_NAMES[3:]}
    del got, parents, order
    n = {(r.fold, r.toxic): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    out, kept = [], None
    for left_out in (None, *range(FOLDS)):
        folds = [k for k in range(FOLDS) if k != left_out]
        toxic = sum(counts[f"t{k}"] for k in folds)
        every = toxic + sum(counts[f"c{k}"] for k in folds)
        if kept is None:
            kept = np.flatnonzero((above < 0) | (every != every[above]))
            own = keys[kept]
        all_toxic, all_clean = (sum(n.get((k, x), 0) for k in folds) for x in (1, 0))
        scores = Lexicon.log_odds(above, depths, toxic, every, (all_toxic + 1) / (all_toxic + all_clean + 2))
        out.append(Lexicon(own, scores[kept].astype(np.float32)))
    return out


def _scored(texts: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` with ``n int``, ``best`` (the best segment's score), ``evidence``, ``score`` and ``passages``.

    A column that has one of these names gives way to the result.
    """
    columns = [c for c in columns if c not in RESULTS]
    names = [*columns, *RESULTS]
    kinds = texts.select(*columns).schema.fields

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, best, evidence, score, out = [], [], [], [], []
        for size, found in model.passages(batch.column(at).to_pylist()):
            n.append(size)
            best.append(max((s for _, _, s in found), default=0.0))
            evidence.append(model.evidence(size, found))
            score.append(model.probability(evidence[-1]))
            real = [(a, b, s, math.exp(-min(700.0, model.bits(s, size)))) for a, b, s in found if model.bits(s, size) >= -math.log(EVALUE)]
            out.append([{"start": a, "end": b, "score": s, "evalue": e} for a, b, s, e in real])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))
        mine = [batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*mine, pa.array(n, pa.int32()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64()), pa.array(score, pa.float64()), pa.array(out, kind)], names)

    results = "n int, best double, evidence double, score double, passages array<struct<start:int,end:int,score:double,evalue:double>>"
    own = "text" in columns and dict(texts.dtypes)["text"] == "string"
    rows = texts.select(*columns) if own else texts.select(*columns, F.col("text").cast("string").alias("_text"))
    at = columns.index("text") if own else len(columns)
    return map_batches(rows, run, StructType([*kinds, *StructType.fromDDL(results).fields]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out, a bounded sample of them (``FIT_DOCUMENTS``).

    Counts come from Spark aggregations over that sample. The law and the map to a probability are fitted on scores that
    the lexicon of the other parts of the sample gives, so a document does not vouch for its own words. The law of the best
    segment in n clean tokens is Gumbel's: its rate solves the Karlin-Altschul equation over clean tokens, its size follows
    from the mean of their best segments. Without toxic or without clean documents the score of everything is the share of
    toxic ones, or 0 without labels.
    """
    sample = sample_labels(labels).select(F.col("doc_id").alias("_label_id"), "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id")).select("text", "toxic", "fold")
    texts = materialize(texts, "labelled")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        p = 0.999 if sizes.get(1) else 0.001
        return Model(slope=0.0, shift=math.log(p / (1 - p)))
    every, *others = lexicons(texts)
    models = [Model(lexicon) for lexicon in others]
    clean = map_batches(texts.where("toxic = 0"), _tally(models), "s int, n long").groupBy("s").agg(F.sum("n").alias("n"))
    model = Model(every, rate=_rate({r.s / 10: r.n for r in clean.collect()}))
    rows = map_batches(texts, _pool(models), "toxic int, n int, best double, pooled double").collect()
    best = [(r.best, math.log(r.n)) for r in rows if not r.toxic and r.n]
    if best:
        model.size = math.exp(model.rate * np.mean([b for b, _ in best]) - 0.5772 - np.mean([ln for _, ln in best]))
    x = np.array([max(0.0, model.bits(r.pooled, r.n)) if r.best else 0.0 for r in rows])
    model.slope, model.shift = _logistic(np.log1p(x), np.array([r.toxic for r in rows], float))
    return model


def _by_fold(batch: pa.RecordBatch, what: str, models: list[Model]) -> list:
    """``values`` or ``passages`` of each text, those of a part by its own model."""
    texts, folds = batch["text"].to_pylist(), np.array(batch["fold"].to_pylist(), np.int64)
    out = [None] * len(texts)
    for k, model in enumerate(models):
        mine = np.flatnonzero(folds == k)
        for i, found in zip(mine, getattr(model, what)([texts[i] for i in mine])):
            out[i] = found
    return out


def _tally(models: list[Model]):
    """How many tokens have each score, in steps of 0.1."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = _by_fold(batch, "values", models)
        steps, n = np.unique(np.rint(10 * np.concatenate([np.empty(0), *values])).astype(np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(steps), pa.array(n.astype(np.int64))], ["s", "n"])

    return count


def _pool(models: list[Model]):
    """Tokens, best segment and pooled score of each document."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _by_fold(batch, "passages", models)
        best = [max((s for _, _, s in parts), default=0.0) for _, parts in found]
        columns = [batch["toxic"], pa.array([n for n, _ in found], pa.int32()), pa.array(best, pa.float64()), pa.array([pooled(p) for _, p in found], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["toxic", "n", "best", "pooled"])

    return score


def _rate(shares: dict[float, int]) -> float:
    """The positive root of sum p exp(rate s) = 1, or 1 where no clean token has a positive score."""
    n = sum(shares.values())
    if not n or not any(s > 0 for s in shares):
        return 1.0
    if sum(s * k for s, k in shares.items()) >= 0:
        return 0.05
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if sum(k * math.exp(min(700.0, mid * s)) for s, k in shares.items()) / n > 1:
            hi = mid
        else:
            lo = mid
    return lo


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of a label, by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(200):
        p = np.exp(-np.logaddexp(0.0, -(a @ w)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / np.abs(step).max(initial=1e-12))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, w[0])), float(w[1])


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row of ``docs(text, ...)`` with ``n int``, ``best``, ``evidence``, ``score double`` and
    ``passages``, the significant ones with token positions and E-values.

    Whole texts are scanned once. Other columns go, and a kept one that is named like a result gives way to it. A null or empty text has no passage and the score of one without evidence. Rows are
    scored one by one, so repeated rows agree and the order is free.
    """
    return _scored(docs, model, list(keep))
