"""A corpus from ``documents`` to token files: language, near copies, benchmark leaks, mixing weights, token ids.

``STAGES`` are functions of ``(spark, docs, sf_dir)``. Each works on all rows that the one before kept; all but the last return the
columns of ``docs``, the last one row per written document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import jaccard, langid, leaks, mixing, tokens
from threadloom.llm.common import boxed, small_side, table, unboxed
from threadloom.session import cut_lineage, shared_folder

#: Ids to drop up to this many rows go to every task; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: What a near copy is here: at least so many percent of the shingles of so many words in common. ``op3_near_copies`` has a measure of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows of whole texts that go to a Python worker at once. Spark's own default suits short rows; with documents it would hold some
#: ten times the memory on both sides.
ROWS_PER_BATCH = 1_000


def _long_rows(spark: SparkSession) -> None:
    """Set the batch size for the session: the stages' tables are computed after they return."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in none of the learned languages, or has no letters; a missing ``lang`` becomes the one that was found."""
    _long_rows(spark)
    model = langid.train(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))))
    told = boxed(docs, langid.identify(model, spark)("text").alias("_language")).filter(~F.col("_language.rejected"))
    lang = F.coalesce(F.col("_row.lang"), F.col("_language.lang"))
    return told.select(*[lang.alias(c) if c == "lang" else F.col(f"_row.`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (0.8 of five-word shingles) the document with the smallest id stays; equal rows become one.

    Rows that share an id are documents of their own, each kept or dropped by its own text; a null id is the smallest.
    """
    _long_rows(spark)
    found = jaccard.near_copies(docs, NEAR_WORDS, NEAR_PERCENT)
    again = found.groupBy("doc_id", "text_mark").agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("stays").alias("_stays"))
    told = again.filter((F.col("_rows") > 1) | ~F.col("_stays")).select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"), "_stays")
    side = small_side(cut_lineage(told), BROADCAST_IDS)
    marked = boxed(docs, "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of")).join(
        side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_mark")), "left")
    single = marked.filter(F.col("_stays").isNull())
    repeated = marked.filter("_stays").dropDuplicates(["doc_id", "text"])
    return unboxed(single.unionByName(repeated))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or a whole shorter one."""
    _long_rows(spark)
    found = leaks.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    hit = cut_lineage(found.select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark")).distinct())
    marked = boxed(docs, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of"))
    return unboxed(marked.join(small_side(hit, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_mark")), "left_anti"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents until the sources have their target weights."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids and read them back: ``(doc_id, start, n_tokens, ids_crc32)``, one row per written document."""
    _long_rows(spark)
    path = shared_folder(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_digests(spark, path)


STAGES = [
    ("language_id", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark_leaks", without_leaks),
    ("source_mix", mixed_sources),
    ("token_files", token_files),
]

#: Language models and hashes are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written as Parquet beside the checkpoints and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
