"""A corpus pipeline: language ID, near copies, repeated passages, mixing, tokens.

Each stage takes what the stage before it kept, as Parquet, and all but the last return the
columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, mixing, simhash, suffixes
from siltstone.llm.common import clear_scratch, owned, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language covers less than this part of their n-grams are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def stage(name: str, before: str | None):
    """A stage: its scratch tables are its own, and those of the stage before, whose rows it gets as written Parquet, are done with."""
    def made(f):
        @functools.wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before and not any("/siltstone-" in n and "/siltstone-stage-" not in n for n in docs.inputFiles()):
                clear_scratch(spark, f"pipeline-{before}")
            with owned(f"pipeline-{name}"):
                return f(spark, docs, sf_dir)

        return run

    return made


@stage("language", None)
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no learned language fits."""
    model = langid.fit(docs, "text", "lang", F.lit(True))
    told = langid.predict(docs.select(*COLUMNS), "text", model, "_lang", "_score")
    return told.where((F.col("_lang") != langid.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


@stage("near_copies", "language")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of near copies."""
    return simhash.deduplicate(docs.select(*COLUMNS), "doc_id", "text")


@stage("repeated_passages", "near_copies")
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of every text the strings of 50 bytes and more that an earlier document has."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), "doc_id", "text")
    kept = F.when(F.col("n_removed") > 0, suffixes.whole_characters(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    return cut.withColumn("text", kept).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage("mixture", "repeated_passages")
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture: file by file and row by row, the sources come at their weights."""
    placed = mixing.mix(docs.select(*COLUMNS), "source", "doc_id")
    return placed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*COLUMNS)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``: where a row stands in the order it was written in, from 0, by the names of the Parquet files and the
    rows in them. Rows that come from no file are counted as they come (in order, with gaps between partitions)."""
    try:
        told = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn("place", F.monotonically_increasing_id())
    counts = told.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # a row per file
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return told.join(F.broadcast(starts), "_file").select(*docs.columns, (F.col("_start") + F.col("_row")).alias("place"))


@stage("tokens", "mixture")
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's tokens, whether they decode to its text, and ``place``, where the document stands in the mixture."""
    ranks, pattern = bpe.vocabulary()
    named = in_order(docs).select("doc_id", "lang", "source", "place", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    coded = bpe.decode(bpe.encode(named, "text", ranks, pattern), "ids", ranks)
    return coded.select("doc_id", "lang", "source", "place", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixed_sources),
    ("tokens", tokens),
]
#: Near copies, repeats and tokens can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}", keep=True)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

