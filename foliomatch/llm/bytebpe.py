"""Byte-level BPE of whole texts, encoded and decoded, in time linear in the text.

Merging by rank looks at a long piece again for every merge. Here tokens are chosen from left to right instead: the longest
token at a place is tried first, and a token may follow another one if merging their joined bytes would give just these
two. Where no token fits, the last one is taken back and a shorter one stands in; a place from which nothing goes on is
never tried again. As each two neighbours of the result are compatible, it is what merging by rank gives.
"""

from __future__ import annotations

import array
import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.common import map_batches

#: How many pieces, how many bytes of one piece and how many pairs of neighbours a worker remembers.
MEMO_PIECES, MEMO_BYTES, MEMO_PAIRS = 300_000, 64, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes with their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """The definition: join the neighbours of the least rank, the leftmost first, while there are any of a rank under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class BytePieceEncoder:
    """Ids of pieces of bytes by the ranks of a vocabulary with all 256 single bytes.

    Bytes stand as Latin-1 letters, so that one automaton over the vocabulary finds the tokens at every place. A token that
    merging never makes is no candidate, except where it is a whole piece, which is looked up first. Choosing from left to
    right needs a vocabulary in which a token ranks after its two halves, as trained ones have it; with any other one pieces
    are merged by rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.whole = ranks
        self.letters = {rank: token.decode("latin-1") for token, rank in ranks.items()}
        self.ids = {letters: rank for rank, letters in self.letters.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.monotone = True
        made = []
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_by_rank(token, ranks, rank)
                if len(parts) != 2:
                    self.monotone &= merge_by_rank(token, ranks) != [token]
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                # single bytes are there from the beginning, whatever their ids
                self.monotone &= all(len(p) == 1 or ranks[p] < rank for p in parts)
            made.append(rank)
        self.automaton = ahocorasick.Automaton()
        for rank in made:
            self.automaton.add_word(self.letters[rank], rank)
        self.automaton.make_automaton()
        usable = {self.letters[rank] for rank in made}
        #: the longest token that a token begins with, itself not counted
        self.shorter = {rank: next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), None) for rank, t in ((r, self.letters[r]) for r in made)}
        self.length = {rank: len(t) for rank, t in self.letters.items()}
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives these two; remembered for ``MEMO_PAIRS`` pairs."""
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._meet(a, b)
        return known

    def _edge(self, token: int, side: int) -> list[int]:
        """What stands at one end of a token while it is made: from its single byte up to itself."""
        out = [token]
        while token in self.halves:
            token = self.halves[token][side]
            out.append(token)
        return out[::-1]

    def _meet(self, a: int, b: int) -> bool:
        """Play the merges at the border in the order of their ranks: would two neighbours across it be joined before both are done?

        The left end of the border grows by a merge left of it, which goes before one across it of the same rank; a merge
        right of it goes after.
        """
        left, right = self._edge(a, 1), self._edge(b, 0)
        never = float("inf")
        i = j = 0
        while True:
            across = self.ids.get(self.letters[left[i]] + self.letters[right[j]], never)
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            if across < grow_left and across <= grow_right:
                return across == never
            if grow_left <= grow_right:
                if grow_left == never:
                    return True
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        rank = self.whole.get(piece)
        if rank is not None:
            return [rank]
        if not self.monotone:
            return [self.whole[t] for t in merge_by_rank(piece, self.whole)]
        text = piece.decode("latin-1")
        longest: list[int] = [0] * len(text)
        length = self.length
        for end, token in self.automaton.iter(text):
            # matches of one start come in the order of their ends, so the last is the longest
            longest[end + 1 - length[token]] = token
        dead = bytearray(len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            last = out[-1] if out else None
            while token is not None:
                end = at + length[token]
                if not dead[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(text) else None
                    break
                token = self.shorter[token]
            else:
                # nothing goes on from here: the last token gives way to a shorter one
                dead[at] = 1
                at -= length[out.pop()]
                token = self.shorter[last]
        return out


class TextEncoder:
    """Ids of texts: the pieces that a pattern cuts, each encoded by itself; short pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.pieces = BytePieceEncoder(ranks)
        self.memo: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = array.array("I", self.pieces.encode(raw)).tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        have, learn = self.memo.get, self._learn
        return b"".join([have(p) or learn(p) for p in self.find(text)])


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker; what it remembers outlives the task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids binary)``: little-endian unsigned 32-bit ids of every whole text, a row for each row.

    A null text is empty and has no ids; special tokens have no meaning in a text. Ranks are read from ``path`` by each
    worker, so the file must be at that place on every machine. A text is in one task; its pieces are encoded in time
    linear in their bytes.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = text_encoder(path, pattern).encode
        ids = [encode(t) if t else b"" for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where those of each id begin and how many they are."""
    if path not in _TABLES:
        ranks = load_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        pool = b"".join(sorted(ranks, key=ranks.get))
        _TABLES[path] = np.frombuffer(pool, np.uint8), np.cumsum(size) - size, size
    return _TABLES[path]


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` with ``decoded binary``, the bytes of its ``ids``; null ids give null.

    An id that the vocabulary does not have is an error, as are bytes that are not whole ids.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pool, begin, size = _tables(path)
        out = []
        for raw in batch["ids"].to_pylist():
            if raw is None:
                out.append(None)
                continue
            ids = np.frombuffer(raw, "<u4")
            if len(ids) and (ids.max() >= len(size) or not size[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            n = size[ids]
            at = np.repeat(begin[ids] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            out.append(pool[at].tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return map_batches(encoded, run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema.fields)}, decoded binary")


def n_ids(ids: Column) -> Column:
    """How many ids a binary column holds."""
    return (F.octet_length(ids) / 4).cast("long")
