"""Token ids in a compact binary store: one zstandard frame per document under a shared dictionary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomatch.llm.common import encoder, map_batches
from foliomatch.plans.stages import shuffle_partitions

#: Documents whose ids train the dictionary, and the bytes of each that are used: a bound, whatever the corpus holds.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 4096, 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3

_BLOCK = (
    "bucket int, block int, n_docs int, n_tokens long, start_in_bucket long, dictionary string, id_bytes int, "
    "doc_ids array<long>, counts array<int>, offsets array<int>, payload binary"
)


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _end(end_id: int | None) -> bytes:
    return b"" if end_id is None else np.array([end_id], "<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_bytes: int) -> bytes:
    """A zstandard dictionary from the serialized ids of at most ``SAMPLE_DOCUMENTS`` documents, picked by hash.

    Of each a span of ``SAMPLE_BYTES`` characters at an offset by hash is used, anywhere in the whole text.

    Too few or too uniform samples give an empty dictionary; frames are then plain zstandard.
    """
    import zstandard

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    picked = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    chosen = known.where(F.col("doc_id").isin([r.doc_id for r in picked])) if picked else known.limit(0)
    last = F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES + 1)
    span = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), last) + 1).cast("int"), F.lit(SAMPLE_BYTES))
    texts = [r.text for r in chosen.select(span.alias("text")).limit(2 * SAMPLE_DOCUMENTS).collect()]
    samples = [_narrow(x + _end(end_id), id_bytes)[:SAMPLE_BYTES] for x in encoder(tokenizer_path).encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in samples if len(x) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_bytes: int = 2) -> None:
    """Encode ``docs(doc_id, text, ...)`` and write the store at ``path`` with Spark's own writer.

    ``path/blocks``: rows of about ``BLOCK_BYTES`` in ascending doc_id, each with the frames of its documents back to
    back (``payload``), the offset index (``doc_ids``, ``counts``, ``offsets``) and the dictionary's SHA-256. A file holds
    one range of doc_ids, and files are named in their order.
    ``path/dictionary``: the dictionary itself. ``path/buckets``: ids before each range of doc_ids.

    A null text counts as empty and still ends with ``end_id``. A null doc_id sorts first. Rows that share a doc_id are
    all kept, ordered by their ids. Other columns are ignored. An empty table gives a store without blocks.
    A vocabulary with an id that does not fit ``id_bytes`` (2 or 4) raises an error.
    """
    from tokenizers import Tokenizer

    largest = max([end_id or 0, *Tokenizer.from_file(tokenizer_path).get_vocab().values()])
    if largest >= 1 << 8 * id_bytes:
        raise ValueError(f"id {largest} does not fit {id_bytes} bytes")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    n_buckets = shuffle_partitions(spark)
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n_buckets for i in range(1, n_buckets)], 0.25 / n_buckets)
    edges, tail = np.array(cuts, dtype=np.float64), _end(end_id)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **shared)
        ids = [x + tail for x in encoder(tokenizer_path).encode(batch.column(1))]
        keys = batch.column(0).to_pylist()
        buckets = np.searchsorted(edges, [-np.inf if k is None else k for k in keys], "left").astype(np.int32)
        frames = [press.compress(_narrow(x, id_bytes)) for x in ids]
        columns = [pa.array(buckets), pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(frames, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "n", "frame"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("start_in_bucket", pa.int64()), ("dictionary", pa.string()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])
        bucket, block, start, rows, held = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, rows, held
            counts, frames = [r[1] for r in rows], [r[2] for r in rows]
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            row = [bucket, block, len(rows), sum(counts), start, digest, id_bytes, [r[0] for r in rows], counts, offsets, b"".join(frames)]
            block, start, rows, held = block + 1, start + sum(counts), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (b != bucket or held >= BLOCK_BYTES):
                    yield flush()
                if b != bucket:
                    bucket, block, start = b, 0, 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield flush()

    encoded = map_batches(docs, encode, "bucket int, doc_id long, n int, frame binary")
    sorted_ = encoded.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "frame")
    sorted_.mapInArrow(build, _BLOCK).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "digest string, dictionary binary").write.parquet(f"{path}/dictionary")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each of n_buckets ranges, a number that is set above and not by the data
    totals.select("bucket", F.coalesce(before, F.lit(0)).alias("bucket_start")).write.parquet(f"{path}/buckets")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of a store: ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. With ``doc_ids`` only their frames are cut out by the offset index
    and decompressed. A dictionary whose SHA-256 differs from the one that a block names raises an error.
    """
    kept = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = kept.digest, bytes(kept.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary in {path} is not the one it names")
    wanted = None if doc_ids is None else set(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)) for i in doc_ids])) if doc_ids else F.lit(False))
    starts = spark.read.parquet(f"{path}/buckets")
    fields = ["bucket_start", "start_in_bucket", "dictionary", "id_bytes", "doc_ids", "counts", "offsets", "payload"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdDecompressor(**shared)
        for batch in batches:
            for r in range(batch.num_rows):
                base, inner, name, width, keys, counts, offsets, payload = (batch.column(i)[r].as_py() for i in range(len(fields)))
                if name != digest:
                    raise ValueError(f"a block was written with dictionary {name}, the store has {digest}")
                at = (np.cumsum(counts) - counts + base + inner).tolist()
                take = [i for i, k in enumerate(keys) if wanted is None or k in wanted]
                view = memoryview(payload)
                ids = [press.decompress(view[offsets[i] : offsets[i + 1]]) for i in take]
                if width == 2:
                    ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
                columns = [pa.array([keys[i] for i in take], pa.int64()), pa.array([at[i] for i in take], pa.int64()), pa.array([counts[i] for i in take], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    joined = blocks.join(F.broadcast(starts), "bucket").select(*fields)
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
