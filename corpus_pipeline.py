"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.llm import mixing, nearcopies, packing, prefixfree, toxicity
from foliomatch.llm.queries import WORD_BPE, tokenizer_path
from foliomatch.plans.stages import materialize, spread

#: A document with a score from here on is rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under ``TOXIC``; the model is fitted on the labels in ``sf_dir``.

    Whole texts are scored row by row, so repeated rows fare alike; a null or empty text has the score of no evidence and
    stays. All columns stay, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score_toxicity(rows, model, keep=("row",)).where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies: those with 0.8 of their shingles in common.

    Shingles are of five words, as all stages on shingles of words take; four bind the query of operator 3 alone. Null
    texts and texts without a word are copies of each other. Repeated rows of the doc_id that stays all stay, and so do
    rows without one.
    """
    return nearcopies.keep_one_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that stand earlier in the corpus.

    A character that is cut goes whole; a document of which nothing but white space is left goes, if there was more.
    A null or empty text stays as it is, and so does one without a repeat. Repeated rows get the same result. ``n_chars``
    of a text that is cut is counted again.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = prefixfree.dedup_substrings(rows, columns=("row",), characters=True)
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    left = out.withColumns({"left": text, "cut": cut}).where(~F.col("cut") | (F.length(F.trim("left")) > 0))
    n = F.when(F.col("cut"), F.length("left").cast("long")).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("left"), "n_chars": n}
    return left.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the target of their source asks for.

    A null source is one of its own, a null or empty text has size 0 and goes with its key; repeated rows are taken or
    left together.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: the pieces of each document with their ids, and where each goes.

    ``(doc_id, piece, start, length, ids binary, ids_crc32, sequence_id, offset)``. A null or empty text is a piece of one
    end id; repeated rows are packed as often as they stand, long texts in several pieces.
    """
    pieces = packing.cut_pieces(docs, tokenizer_path(WORD_BPE), capacity=2048, end_id=0)
    return packing.pack(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenizers, hashes and models have no SQL; ``tests/llm/test_pipeline.py`` compares every stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
