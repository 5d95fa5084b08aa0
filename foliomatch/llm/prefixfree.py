"""Removing repeated byte strings by triggers of a rolling hash.

The trigger of a window of ``length`` bytes is its least hash of ``GRAM`` bytes, the first of equal ones. So equal windows
have the same trigger at the same place, whatever stands around them. An occurrence of a trigger has an entry: the trigger
with as much text around it as a window can reach.

Where an entry occurs again, all windows around it occur again: that is settled on two hashes, of the trigger and of the
entry, without texts, first among the rows of a task and then by one shuffle. What is left are different entries with the
same trigger: where a repeated passage begins or ends. Their texts are fetched, and their windows, those that start at the
same place before the trigger, are compared by their bytes in sorted order. Of a trigger with very many entries these are
dealt anew by more bytes for fewer windows, so that what is dealt stays in proportion to the entries. This is no prefix-free
parsing: neither a dictionary nor a parse has a suffix array, see the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomatch.llm.common import map_batches
from foliomatch.plans.stages import discard, materialize, shuffle_partitions

LENGTH, GRAM = 100, 24
#: Texts are hashed in segments of so many bytes, which overlap by a window.
SEGMENT = 1 << 18
#: Occurrences that a task looks through at once for entries that it has itself met before.
HELD = 1 << 19
#: Different entries of one trigger that are compared together; more are told apart by what their windows have in common.
TOGETHER = 2000
#: Into how many parts the places before a trigger are cut for that, one after the other.
PARTS = (2, 11)
#: Entries that are compared at once at least, if there are so many, and the windows of these that are sorted at once at most.
BUNCH, SORTED = 1000, 1 << 15
#: Entries that still have too much in common whose windows a task compares among themselves before they are dealt out.
CHUNK = 2000
#: Keys over which the entries of one trigger are dealt when crowded triggers are told from others.
SALTS = 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, np.uint64(inverse))]
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every ``gram`` bytes."""
    n = len(data) - gram + 1
    up, down = _powers(SEGMENT + 4 * LENGTH if len(data) <= SEGMENT + 4 * LENGTH else len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = (sums[gram:] - sums[:-gram]) * down[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def triggers(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` of the triggers of all windows of ``length`` bytes, each once, ascending."""
    reach, places, hashes = length - gram + 1, [], []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        h = gram_hashes(data[at : at + SEGMENT + length - 1], gram)
        # the order among hashes, with the place in the low bits: the least is the first of equal ones
        low = np.uint64((1 << 19) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & low).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        places.append(place + at)
        hashes.append(h[place])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, value = np.concatenate(places), np.concatenate(hashes)
    keep = np.r_[True, place[1:] != place[:-1]]  # a trigger may be met on both sides of a cut
    return place[keep], value[keep]


def entry_bounds(place: np.ndarray, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the dictionary entry around a trigger begins and ends: as far as a window with it can reach."""
    return np.maximum(0, place - (length - gram)), np.minimum(size, place + length)


def _keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``(_id, _key, text, *more)``: doc_id with null as the smallest long, and a hash that tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    least = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"), *more)


def _once(keyed: DataFrame) -> DataFrame:
    """One row for each id and text. Repeated ones are found by their keys; texts are dealt out only if there are any."""
    key = ["_id", "_key"]
    repeated = materialize(keyed.groupBy(*key).count().where("count > 1").select(*key), "repeated-rows")
    if repeated.isEmpty():
        return keyed
    # each task keeps one of the rows of a key, so a row that makes up a third of the table is met once a task
    one = keyed.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    return keyed.join(repeated, key, "left_anti").unionByName(one)


def _parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Occurrences ``(trigger, entry, id, key, at)`` with the place ``at``; ``entry`` is null for those whose entry the same
    task has met in an earlier place. They need no further look, so any trigger will do to deal them out: a passage that
    very many documents share comes to the shuffle once from each task."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> pa.RecordBatch:
            trigger, entry, id_, key, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((at, id_, entry, trigger))
            trigger, entry, id_, key, at = (c[order] for c in (trigger, entry, id_, key, at))
            again = np.r_[False, (entry[1:] == entry[:-1]) & (trigger[1:] == trigger[:-1])]
            # the same place of another text of the id is the same occurrence, not an earlier one
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            again &= (id_ != id_[first]) | (at != at[first])
            with np.errstate(over="ignore"):
                spread = np.where(again, id_ * 1_000_003 + at, trigger)
            columns = [pa.array(spread), pa.array(entry, mask=again), pa.array(id_), pa.array(key), pa.array(at)]
            return pa.RecordBatch.from_arrays(columns, ["trigger", "entry", "id", "key", "at"])

        n = 0
        for batch in batches:
            for id_, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                if len(raw) < length:
                    continue
                place, value = triggers(raw, length, gram)
                lo, hi = entry_bounds(place, len(raw), length, gram)
                entry = np.array([xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
                # an entry cut short by the text's start has its trigger elsewhere
                entry ^= (place - lo).astype(np.uint64)
                own = [np.full(len(place), x, np.int64) for x in (id_, key)]
                held.append((value.view(np.int64), entry.view(np.int64), *own, place))
                n += len(place)
                if n >= HELD:
                    yield settle()
                    n = 0
        if held:
            yield settle()

    return docs.mapInArrow(run, "trigger long, entry long, id long, key long, at long")


def _first_of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From occurrences sorted by trigger, entry, id and place: those of an entry met before, as ``(null, id, key, at)``; and
    the first ones of triggers with several entries, as ``(trigger, id, key, at)``, with those at the same place of another
    text of the id. It keeps one occurrence at a time."""
    last = None  # trigger, entry, id, key, at and whether it was given out
    names = ["trigger", "id", "key", "at"]
    for batch in batches:
        if not batch.num_rows:
            continue
        met = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        t, e, i, k, a = (c.fill_null(0).to_numpy() for c in batch.columns)
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(met.sum()), pa.int64()), pa.array(i[met]), pa.array(k[met]), pa.array(a[met])], names)
            t, e, i, k, a = (c[~met] for c in (t, e, i, k, a))
            if not len(t):
                continue
        if last is not None:
            t, e, i, k, a = (np.r_[x, c] for x, c in zip(last, (t, e, i, k, a)))
        same_t = np.r_[False, t[1:] == t[:-1]]
        again = same_t & np.r_[False, e[1:] == e[:-1]]
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(t))))
        covered = again & ((i != i[head]) | (a != a[head]))
        beside = again & ~covered
        heads = np.flatnonzero(~again)
        ht = t[heads]
        several = np.r_[False, ht[1:] == ht[:-1]] | np.r_[ht[1:] == ht[:-1], False]
        out = heads[several]
        if last is not None and len(out) and out[0] == 0 and last[5]:
            out = out[1:]
        end = int(head[-1])
        given = bool(several[-1]) or (last is not None and end == 0 and last[5])
        last = (*(c[end : end + 1] for c in (t, e, i, k, a)), given)
        out = np.r_[out, np.flatnonzero(beside)]
        for trigger, rows in ((pa.nulls(int(covered.sum()), pa.int64()), covered), (pa.array(t[out]), out)):
            if len(trigger):
                yield pa.RecordBatch.from_arrays([trigger, pa.array(i[rows]), pa.array(k[rows]), pa.array(a[rows])], names)


def _most_shared(side: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the most leading bytes that another row of its group has too; zeros behind a text's end count as bytes."""
    most = np.zeros(len(side), np.int64)
    if side.size:
        order = np.lexsort((side.view(f"S{side.shape[1]}").ravel(), group))
        side, group = side[order], group[order]
        differ = side[1:] != side[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
        common[group[1:] != group[:-1]] = 0
        most[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return most


def _compared(batch: pa.RecordBatch, length: int, gram: int) -> pa.RecordBatch:
    """``(id, _key, lo, hi)`` of windows in entries sorted by group, id and place that equal an earlier one, runs joined.

    A window must have an equal on both sides of the trigger, so only those are looked at that reach no further than the
    entry has bytes in common with the next ones in the order of what stands before and of what follows. They are put in
    order of their bytes for each place before the trigger.
    """
    reach, n = length - gram + 1, batch.num_rows
    group, id_, key, at, before = (c.to_numpy() for c in batch.columns[:5])
    lo, hi = (c.to_numpy() for c in batch.columns[6:]) if batch.num_columns > 6 else (0, reach - 1)
    entry = batch.column(5).cast(pa.binary())
    offsets = np.frombuffer(entry.buffers()[1], np.int32)[entry.offset : entry.offset + n + 1].astype(np.int64)
    size = np.diff(offsets)
    # texts side by side, with their triggers in one column
    text = np.zeros((n, reach - 1 + length), np.uint8)
    begin = np.arange(n) * text.shape[1] + reach - 1 - before
    place = np.arange(offsets[0], offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    text.reshape(-1)[place] = np.frombuffer(entry.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    after = np.minimum(size - before, _most_shared(np.ascontiguousarray(text[:, reach - 1 :]), group))
    least = np.maximum(lo, length - after)
    most = np.minimum(np.minimum(hi, before), _most_shared(np.ascontiguousarray(text[:, : reach - 1][:, ::-1]), group))
    number = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    every = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)
    count = np.maximum(0, most - least + 1)
    step = reach if count.sum() <= SORTED else max(1, SORTED // n)
    hits = []
    for back0 in range(0, reach, step):
        first = np.maximum(least, back0)
        count = np.maximum(0, np.minimum(most, back0 + step - 1) - first + 1)
        if not (total := int(count.sum())):
            continue
        row = np.repeat(np.arange(n), count)
        back = np.arange(total) + np.repeat(first - np.cumsum(count) + count, count)
        window = every[row, reach - 1 - back].view(f"S{length}").ravel()
        where = number[row] * reach + back
        order = np.lexsort((window, where))  # equal ones stay in the order of the corpus
        row, back, window, where = row[order], back[order], window[order], where[order]
        again = np.r_[False, (where[1:] == where[:-1]) & (window[1:] == window[:-1])]
        head = row[np.maximum.accumulate(np.where(again, 0, np.arange(total)))]
        again &= (id_[row] != id_[head]) | (at[row] != at[head])  # another text of the id at the same place is the same occurrence
        hits.append((row[again], back[again]))
    row, back = (np.concatenate(c) for c in zip(*hits)) if hits else (np.empty(0, np.int64),) * 2
    order = np.lexsort((back, row))
    row, back = row[order], back[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (back[1:] != back[:-1] + 1)][: len(row)]
    last = np.r_[new[1:], True][: len(row)]
    row, start, end = row[new], at[row[new]] - back[last], at[row[new]] - back[new] + length
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (id_[row], key[row], start, end)], ["id", "_key", "lo", "hi"])


def _equal_windows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """``_compared`` over whole groups of entries ``(group, id, key, at, before, entry)``, which may be followed by the least
    and most bytes before the trigger, ``(lo, hi)``, that are looked at. It keeps ``BUNCH`` entries and one group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if rest:
            batch = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
        group, at = batch.column(0).to_numpy(), 0
        for end in (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist():
            if end - at >= BUNCH:
                yield _compared(batch.slice(at, end - at), length, gram)
                at = end
        rest = [batch.slice(at)] if at < batch.num_rows else []
    for batch in rest:
        yield _compared(batch, length, gram)
    pa.default_memory_pool().release_unused()


def _runs(hits: list[tuple[int, int, int]], length: int) -> pa.RecordBatch:
    """``(id, _key, lo, hi)`` of windows given as ``(id, key, start)``, those that follow each other joined."""
    out = []
    for id_, key, start in sorted(set(hits)):
        if out and out[-1][:2] == [id_, key] and start == out[-1][3] - length + 1:
            out[-1][3] += 1
        else:
            out.append([id_, key, start, start + length])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "_key", "lo", "hi"])


def _windows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """From entries ``(group, id, key, at, before, entry)``, or with ``(lo, hi)``: their windows as ``(window, id, key, at, back, n)``.

    Of equal windows among ``CHUNK`` entries only the first is dealt out by its bytes, so that a window of very many
    documents comes to the shuffle once from each chunk; the others are marked by a null window, as one row for the ``n``
    that begin at ``back`` and the next places before the trigger.
    """
    for batch in batches:
        for at0 in range(0, batch.num_rows, CHUNK):
            rows = []
            for _, id_, key, at, before, entry, *ends in zip(*(c.to_pylist() for c in batch.slice(at0, CHUNK).columns)):
                lo, hi = ends or (0, length - gram)
                # equal windows have their trigger at the same place, so bytes and place before it name a window
                rows += [(entry[before - b : before - b + length], b, id_, at, key) for b in range(lo, min(before, hi) + 1) if before - b + length <= len(entry)]
            rows.sort()
            out, marked, first = [], [], None
            for row in rows:
                if first is None or row[:2] != first[:2]:
                    first = row
                elif row[2:4] != first[2:4]:
                    marked.append((row[2], row[4], row[3], row[1]))
                    continue  # else another text of the id at the same place, which is the same occurrence
                out.append((row[0], row[2], row[4], row[3], row[1], 1))
            marked.sort()
            for _, run in groupby(enumerate(marked), lambda x: (*x[1][:3], x[1][3] - x[0])):
                run = [m for _, m in run]
                out.append((None, *run[0], len(run)))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["window", "id", "key", "at", "back", "n"])


def _later_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From windows sorted by bytes, place before the trigger, id and place in the text: spans of all but the first of
    equal ones, and of the marked ones. It keeps one window at a time."""
    first, hits = None, []
    for batch in batches:
        for window, id_, key, at, back, n in zip(*(c.to_pylist() for c in batch.columns)):
            if window is not None:
                if first is None or first[:2] != (window, back):
                    first = (window, back, id_, at)
                if first[2:] == (id_, at):
                    continue
            hits += [(id_, key, at - b) for b in range(back, back + n)]
        if len(hits) > 50_000:
            yield _runs(hits, length)
            hits = []
    if hits:
        yield _runs(hits, length)


def _narrowed(entries: DataFrame, parts: int, length: int) -> DataFrame:
    """``(group, id, key, at, before, entry, lo, hi)`` for each of ``parts`` parts of the places ``lo`` to ``hi`` before the trigger.

    The entry is cut to what its windows in the part reach, and the group is a hash of the bytes that all of them hold, so
    equal windows share it. Entries without a window in the part are left out.
    """
    width = F.ceil((F.col("hi") - F.col("lo") + 1) / parts).cast("int")
    rows = entries.withColumn("_width", width).withColumn("lo", F.explode(F.sequence("lo", "hi", "_width")))
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("_width") - 1, "hi"))
    rows = rows.where(f"before >= lo AND before - hi + {length} <= length(entry)")
    group = F.xxhash64("lo", F.expr(f"substring(entry, before - lo + 1, {length} - hi + lo)"))
    begin = F.greatest(F.col("before") - F.col("hi"), F.lit(0))
    rows = rows.withColumns({"group": group, "_from": begin})
    text = F.expr(f"substring(entry, _from + 1, least(length(entry), before - lo + {length}) - _from)")
    return rows.select("group", "id", "key", "at", (F.col("before") - F.col("_from")).alias("before"), text.alias("entry"), "lo", "hi")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(_id, _key, spans array<struct<lo, hi>>)``: bytes covered by ``length``-byte strings that also start earlier.

    Each step is written, and its shuffle files go with it: together they are several times the texts.
    """
    spark = docs.sparkSession
    keyed = _once(_keyed(docs))
    n = shuffle_partitions(spark)
    written: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        written.append(materialize(df, name, release=True))
        return written[-1]

    parsed = _parse(keyed, length, gram).repartition(n, "trigger").sortWithinPartitions("trigger", "entry", "id", "at")
    found = step(parsed.mapInArrow(_first_of_entries, "trigger long, id long, key long, at long"), "occurrences")

    # texts around the triggers whose entries differ
    wanted = found.where("trigger IS NOT NULL").groupBy("id", "key").agg(F.collect_list(F.struct("trigger", "at")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at0 in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at0, 64), []
                for id_, key, text, asked in zip(*(c.to_pylist() for c in part.columns)):
                    raw = text.encode()
                    for x in asked:
                        place = x["at"]
                        lo, hi = max(0, place - (length - gram)), min(len(raw), place + length)
                        rows.append((x["trigger"], id_, key, place, place - lo, raw[lo:hi]))
                kinds = [("group", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("entry", pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [name for name, _ in kinds])

    asked = keyed.join(wanted.toDF("_id", "_key", "wanted"), ["_id", "_key"]).select("_id", "_key", "text", "wanted")
    entries = step(asked.mapInArrow(fetch, "group long, id long, key long, at long, before int, entry binary"), "entries")
    kinds = "id long, _key long, lo long, hi long"

    def edges(entries: DataFrame, parts: tuple[int, ...]) -> DataFrame:
        """Spans of windows that equal an earlier one of their group: a trigger, or bytes around it."""
        crowded = step(entries.groupBy("group").count().where(F.col("count") > TOGETHER).select("group"), "crowded")
        # both sides are dealt by group and salt: the list of these groups grows with the corpus and is not sent around
        salts = crowded.select("group", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salted = entries.withColumn("_salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int"))
        dealt = salted.join(salts, ["group", "_salt"], "left_anti").select(*entries.columns)
        dealt = dealt.repartition(n, "group").sortWithinPartitions("group", "id", "at")
        spans = dealt.mapInArrow(lambda it: _equal_windows(it, length, gram), kinds)
        if crowded.isEmpty():
            return spans
        many = salted.join(salts, ["group", "_salt"], "left_semi").select(*entries.columns)
        if parts:
            # no task gathers such a group: its entries are dealt anew by more bytes than the trigger's, for fewer windows at a time
            if "lo" not in many.columns:
                many = many.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
            return spans.unionByName(edges(step(_narrowed(many, parts[0], length), "narrowed"), parts[1:]))
        windows = many.mapInArrow(lambda it: _windows(it, length, gram), "window binary, id long, key long, at long, back int, n int")
        deal = F.when(F.col("window").isNull(), F.xxhash64("id", "at")).otherwise(F.xxhash64("window", "back"))
        windows = windows.repartition(n, deal).sortWithinPartitions("window", "back", "id", "at")
        return spans.unionByName(windows.mapInArrow(lambda it: _later_windows(it, length), kinds))

    place = F.col("at")
    whole = found.where("trigger IS NULL").select("id", F.col("key").alias("_key"), F.greatest(F.lit(0), place - (length - gram)).alias("lo"), (place + length).alias("hi"))
    spans = whole.unionByName(edges(entries, PARTS)).groupBy(F.col("id").alias("_id"), "_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = step(spans, "spans")
    for used in written[:-1]:
        discard(used)
    return out


def _merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union, within the text."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], size)) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _whole_characters(runs: list[tuple[int, int]], raw: bytes) -> list[tuple[int, int]]:
    """Runs grown to the borders of the UTF-8 characters that they cut."""
    out = []
    for lo, hi in runs:
        while lo and raw[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        out.append({"lo": lo, "hi": hi})
    return _merged(out, len(raw))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, columns: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """``(doc_id, *columns, n_bytes, spans array<struct<lo long, hi long>>, kept binary)`` for every row of ``docs``.

    Texts are UTF-8 bytes, a null text is empty. ``spans`` are the maximal runs of bytes that a ``length``-byte string
    covers which also starts earlier: in a document with a smaller doc_id, or earlier in the same one. Matches end at
    the text's ends. Strings are judged on the input. ``kept`` holds the other bytes in order; it may cut a character,
    unless ``characters`` asks that one whose bytes are covered in part goes whole. ``columns`` must not be named like a
    result or begin with an underscore; a struct takes any.
    A null doc_id comes before all others. Rows that share a doc_id are one document whose texts lie over each other:
    neither is earlier at the same place, and repeated rows get the same result. Empty tables give no rows.
    """
    fields = ["doc_id", "_id", "_key", "text", *columns]
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *columns).select(*fields)
    rows = rows.join(repeated_spans(docs, length, gram), ["_id", "_key"], "left").select(*fields, "spans")
    kinds = rows.select("doc_id", *columns).schema.fields

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, marks in zip(batch.column(3).to_pylist(), batch.column(len(fields)).to_pylist()):
            raw = text.encode()
            runs = _merged(marks, len(raw))
            if characters:
                runs = _whole_characters(runs, raw)
            at, parts = 0, []
            for lo, hi in runs:
                parts.append(raw[at:lo])
                at = hi
            sizes.append(len(raw))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            kept.append(b"".join([*parts, raw[at:]]))
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        own = [batch.column(0), *(batch.column(i) for i in range(4, len(fields)))]
        names = ["doc_id", *columns, "n_bytes", "spans", "kept"]
        return pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names)

    results = StructType.fromDDL("n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept binary")
    return map_batches(rows, cut, StructType([*kinds, *results.fields]))


