"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes that a Python task handles at once at most, so that very long texts do not pile up.
SLICE_ROWS, SLICE_BYTES = 8192, 8 << 20


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` by slices of at most ``SLICE_ROWS`` rows, of mostly ``SLICE_BYTES``; ``fn`` may return None for no rows.

    A task that ends gives back what Arrow holds and does not use, as its worker lives on in other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                out = fn(batch.slice(at, step))
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class ChunkEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, by the ``tokenizers`` library.

    A space or line feed between two characters that are not white space always starts a new pre-token in the
    tokenizers used here (byte-level BPE and BPE with word ends), as does a final comma or full stop after a letter, and
    no merge crosses pre-tokens. So Arrow cuts the texts of a batch there and numbers their distinct pieces, the library
    encodes a piece when it is first met, and ids are gathered by number. About ``memo`` pieces are remembered, as Arrow
    strings with their ids in one array; beyond that only those of the present batch stay. Pieces of Latin-1 letters alone are one pre-token and
    go straight to the library's model; all others take its whole pipeline. Texts with white space beside white space,
    or at an end, are cut by a slower rule.
    """

    #: Stands before the first piece of a text, which has no space before it.
    FIRST = "\U0010ffff"
    _CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
    _LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\Z")
    _SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
    _ODD = rf"{_SPACE}[ \n]|[ \n]{_SPACE}|^[ \n]|[ \n]\z|\x{{10ffff}}"

    def __init__(self, path: str, memo: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memo = memo
        self._forget()
        self.folds = self._ids(["A"]) == self._ids(["a"])
        self.spaces = bool(self._ids([" a"])[0] != self._ids(["a"])[0])
        self.marks = {x: self._ids([x])[0] for x in ("", ".", ",", "\n")}
        # tokens that begin with a space, or else those that end a word
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(self.letters[32]) if self.spaces else t.endswith("</w>"))]] = True
        probe = ["word", "Stra\u00dfe", "\u00c9t\u00e9.", "\nIl", "unbelievably,", self.FIRST + "A", self.FIRST + "to."]
        self.direct = True
        self.direct = self._learn(probe) == self._ids([*map(self._spelled, probe)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in out]

    def _spelled(self, piece: str) -> str:
        return piece[1:] if piece[:1] == self.FIRST else piece if piece[:1] == "\n" else " " + piece

    def _plain(self, word: str) -> bytes:
        """Ids of a Latin-1 word without a space before it."""
        written = word.lower() if self.folds else word
        if not written.isascii():
            written = written.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of Latin-1 words with a space before them: many in one text, told apart by tokens that begin or end one."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(some):
                out.update(zip(some, self._ids([" " + w for w in some])))
                continue
            cuts = [*edges.tolist(), len(ids)] if self.spaces else [0, *(edges + 1).tolist()]
            raw = ids.tobytes()
            out.update(zip(some, [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]))
        return out

    def _is_word(self, word: str) -> bool:
        return word.isalpha() and len(word) <= 60 and (word.isascii() or self._LATIN.match(word) is not None)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that are not remembered."""
        marks, rest, waiting, out = self.marks, [], [], {}
        for p in new:
            end, head = p[-1:], p[:1]
            word = p[:-1] if end == "," or end == "." else p
            if not self.direct:
                rest.append(p)
            elif head == "\n" or head == self.FIRST:
                if self._is_word(word[1:]):
                    out[p] = (marks["\n"] if head == "\n" else b"") + self._plain(word[1:]) + (marks[end] if word is not p else b"")
                else:
                    rest.append(p)
            elif self._is_word(word):
                waiting.append((p, word, end if word is not p else ""))
            else:
                rest.append(p)
        bare = list({w for _, w, end in waiting if end})
        at = pc.index_in(pa.array(bare, pa.string()), value_set=self.keys)
        have = {w: self.pool[self.begin[i] : self.begin[i] + self.size[i]].tobytes() for w, i in zip(bare, at.to_pylist()) if i is not None}
        have.update(self._words([*{w for _, w, _ in waiting} - have.keys()]))
        for p, word, end in waiting:
            out[p] = have[word] + marks[end] if end else have[word]
        for at in range(0, len(rest), 4096):
            out.update(zip(rest[at : at + 4096], self._ids([*map(self._spelled, rest[at : at + 4096])])))
        return [out[p] for p in new]

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Remember nothing, or only the pieces numbered ``keep``."""
        if keep is None:
            self.keys, self.pool = pa.array([], pa.string()), np.empty(0, np.uint32)
            self.begin = self.size = np.empty(0, np.int64)
        else:
            self.pool = self._gather(keep)
            self.keys, self.size = self.keys.take(pa.array(keep)), self.size[keep]
            self.begin = np.cumsum(self.size) - self.size

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces one after the other."""
        n = self.size[numbers]
        upto = np.cumsum(n)
        at = np.repeat((self.begin[numbers] - (upto - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at]

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number under which each of some distinct pieces is remembered; new ones are learned."""
        found = pc.index_in(pieces, value_set=self.keys)
        if len(self.keys) > self.memo:
            keep = found.drop_null().to_numpy()
            self._forget(keep)
            found = pc.index_in(pieces, value_set=self.keys)
        if found.null_count:
            new = pieces.filter(found.is_null())
            values = self._learn(new.to_pylist())
            n = len(self.keys)
            self.keys = pa.concat_arrays([self.keys, new])
            self.size = np.concatenate([self.size, np.fromiter(map(len, values), np.int64, len(values)) // 4])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(values), np.uint32)])
            self.begin = np.cumsum(self.size) - self.size
            out = found.fill_null(0).to_numpy().astype(np.int64)
            out[found.is_null().to_numpy(zero_copy_only=False)] = n + np.arange(len(values))
            return out
        return found.to_numpy().astype(np.int64)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; a null one is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(column, self._ODD).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~odd)), "\n", " \n"), " ")
        words = lists.flatten()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = np.zeros(len(words), bool)
        first[offsets[:-1]] = True
        words = pc.if_else(pa.array(first), pc.binary_join_element_wise(self.FIRST, words, ""), words)
        out, slow, ends = np.empty(len(column), object), [], [0]
        for text in column.filter(pa.array(odd)).to_pylist():
            parts = self._CUT.split(text)
            if self.FIRST not in text:
                slow += [self.FIRST + parts[0], *parts[1:]]
            ends.append(len(slow))
        coded = pa.concat_arrays([words, pa.array(slow, pa.string())]).dictionary_encode()
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        all_ids = self._gather(numbers)
        upto = np.concatenate([[0], np.cumsum(self.size[numbers])])
        for rows, cuts in ((~odd, upto[offsets].tolist()), (odd, upto[len(words) + np.array(ends)].tolist())):
            out[rows] = [all_ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(odd):
            if self.FIRST in (text := column[int(i)].as_py()):
                out[i] = self._ids([text])[0]
        return out.tolist()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker; its memory of pieces outlives the task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
