"""Packing token pieces into sequences of fixed length by exact complements."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliomatch.llm.common import encoder, map_batches

#: Rows that one (length, salt) group of the ranking holds on average at most.
RANK_ROWS = 200_000
RESULTS = ("sequence_id", "offset")


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids binary)``: the documents' ids, cut where longer than ``capacity``.

    Ids are little-endian unsigned 32-bit. A null text counts as empty; with an ``end_id`` every document has at least
    one piece. Repeated rows give repeated pieces; other columns are ignored.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        ids = encoder(tokenizer_path).encode(batch.column(1))
        for key, x in zip(batch.column(0).to_pylist(), ids):
            x += tail
            for i, at in enumerate(range(0, len(x), 4 * capacity)):
                part = x[at : at + 4 * capacity]
                rows.append((key, i, at // 4, len(part) // 4, part))
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, cut, "doc_id long, piece int, start long, length long, ids binary")


class Stock:
    """How many pieces of each length are left, with an index of the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity, self._stale = capacity, True

    def take(self, parts: list[int], times: int) -> None:
        for x in parts:
            self.left[x] -= times
        self._stale = self._stale or bool((self.left[parts] == 0).any())

    def times(self, parts: list[int]) -> int:
        """How often this combination can be taken."""
        return min(int(self.left[x]) // parts.count(x) for x in set(parts))

    def pairs(self) -> np.ndarray:
        """Whether some two lengths with pieces sum to each value; it may name a pair of which one piece is left."""
        if self._stale:
            have = (self.left > 0).astype(np.float32)
            self._pairs = np.fft.irfft(np.fft.rfft(have, 2 * len(have)) ** 2)[: len(have)] > 0.5
            self._stale = False
        return self._pairs

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int, held: int = 0) -> list[int] | None:
        """Two pieces that sum to ``gap``, the longer as long as can be, beside one piece ``held``."""
        if gap < 2 or not self.pairs()[gap]:
            return None
        long = np.arange(gap - 1, (gap - 1) // 2, -1)
        left = self.left.copy() if held else self.left
        if held:
            left[held] -= 1
        ok = (left[long] > 0) & (left[gap - long] > np.where(long == gap - long, 1, 0))
        at = int(ok.argmax())
        return [int(long[at]), int(gap - long[at])] if ok[at] else None

    def triple(self, gap: int) -> list[int] | None:
        if gap < 3:
            return None
        firsts = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for a in firsts[(self.left[firsts] > 0) & self.pairs()[gap - firsts]]:
            if rest := self.pair(gap - int(a), held=int(a)):
                return [int(a), *rest]
        return None


def solve(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, times)`` that use every piece once, from the number of pieces of each length.

    Longest first, a length opens sequences; a gap that one, two or three pieces fill exactly is filled so, as often as
    their counts allow. Where none does, the longest piece that fits goes in first, which is best fit, and the rest of
    the gap is tried again. Work and patterns depend on the number of different lengths, not on the number of pieces:
    each step uses up a length or closes a pattern.
    """
    stock, out = Stock(counts, capacity), []
    while True:
        lengths = np.flatnonzero(stock.left[1:] > 0) + 1
        if not len(lengths):
            return out
        parts, gap = [int(lengths[-1])], capacity - int(lengths[-1])
        stock.take(parts, 1)
        while gap > 0:
            fill = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            if not fill:
                fits = np.flatnonzero(stock.left[1 : gap + 1] > 0)
                if not len(fits):
                    break
                fill = [int(fits[-1]) + 1]
            stock.take(fill, 1)
            parts += fill
            gap -= sum(fill)
        more = stock.times(parts)
        if more:
            stock.take(parts, more)
        out.append((parts, 1 + more))


def place(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the slots ``(first rank, first sequence, offset)``: rank r of a slot goes to sequence r - first + ..."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, times in patterns:
        offset = 0
        for x in parts:
            insort(slots.setdefault(x, []), (used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(v, np.int64) for x, v in slots.items()}


def pack(pieces: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id long`` and ``offset long`` to ``pieces(length, *key, ...)``; other columns stay, but those of these names.

    Offsets in a sequence are gapless from 0. Pieces of the same length are told apart by their rank under ``key`` and a
    hash of the whole row, so reruns agree; rows equal in everything are interchangeable. The driver sees one count for
    each length from 1 to ``capacity`` and no row. The ranks are summed over salted groups, so that one very common
    length does not gather in one task. A null length or one outside 1..capacity raises an error.
    """
    fits = F.when(F.col("length").between(1, capacity), F.col("length")).cast("int")
    counts = {r.fits: r.n for r in pieces.groupBy(fits.alias("fits")).agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    salts = max(16, -(-sum(counts.values()) // RANK_ROWS))
    slots = place(solve(counts, capacity))

    row = F.struct(*[c for c in pieces.columns if c not in RESULTS]).alias("row")
    names = [f"k{i}" for i in range(len(key))]
    rows = pieces.select(row, fits.alias("length"), F.xxhash64(*pieces.columns).alias("h"), *[F.col(k).alias(n) for k, n in zip(key, names)])
    rows = rows.withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    # at most capacity * salts rows, and salts is rows / RANK_ROWS: bounded by capacity / RANK_ROWS of the rows
    sums = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    over = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("length", "salt", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*names, "h"))
    ranked = rows.withColumn("nth", nth - 1).join(ahead, ["length", "salt"]).select("row", "length", (F.col("nth") + F.col("ahead")).alias("rank"))

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        out = np.zeros((2, len(length)), np.int64)
        for x in np.unique(length):
            mine = length == x
            table = slots[int(x)]
            at = np.searchsorted(table[:, 0], rank[mine], "right") - 1
            out[0, mine] = table[at, 1] + rank[mine] - table[at, 0]
            out[1, mine] = table[at, 2]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1])], ["row", *RESULTS])

    schema = StructType([ranked.schema["row"], *[StructField(n, LongType()) for n in RESULTS]])
    return map_batches(ranked, put, schema).select("row.*", *RESULTS)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """The packed pieces with their ids, ready to be written as training sequences."""
    return pack(cut_pieces(docs, tokenizer_path, capacity, end_id), capacity)
