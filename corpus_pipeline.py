"""The corpus pipeline: documents in, training sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage cuts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from lodestone.llm._scratch import written
from lodestone.llm._skew import apart
from lodestone.llm._tables import small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep; their trees learn from the labelled rows among ``docs``. Null and empty texts go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the smallest id, and one of repeated rows.

    Rows without an id stay. Of rows that share an id the one of the smallest hash stays.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = near_dedup.near_duplicates(docs)
    # only ids leave, so the texts are not shuffled for the others' sake
    out = written(found.where("NOT kept").select("doc_id").distinct(), "dropped")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = written(again, "repeated")
    # rows without an id have no part in the joins, where they would all meet in one task
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    left = docs.join(apart(out), "doc_id", "left_anti")
    if again.isEmpty():
        return left.unionByName(nameless)
    many = left.join(apart(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "lang", "source", "n_chars").alias("h"), "text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*").select(*COLUMNS)
    return left.join(apart(again), "doc_id", "left_anti").unionByName(many).unionByName(nameless)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines and sentences that occur earlier; a document of which nothing remains goes."""
    small_batches(spark)
    return substring_dedup.clean(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark aligns; null texts and items match nothing."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every remaining document, cut where longer, in sequences of at most 2048 tokens; a null text is an empty one."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tight=True)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmarks),
    ("packing", sequences),
]

#: Trees, alignment and tokenizer are beyond SQL; a test runs a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
