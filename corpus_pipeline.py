"""The corpus pipeline: each stage works on all rows that the one before it kept.

``documents`` goes through quality classifier, n-gram Jaccard join, suffix-array dedup, benchmark
decontamination, and BPE encoding and decoding. All stages but the last return the columns of
documents. Rows that share a doc_id are one document, of which the second stage leaves one. Each row
without a doc_id is a document of its own; within a stage it goes by a number beyond all ids, so of
copies the one with an id stays, and keeps its null. Null texts have no words and are rejected by the
first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import bpe, decontaminate, jaccard_join, site_quality, suffix_dedup
from flowgauge.llm.common import written
from flowgauge.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five-word shingles, a similarity of 0.8.
NEAR = jaccard_join.Similarity(num=4, den=5, width=5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids from here on are those of rows that have none.
_UNNAMED = 1 << 62


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a number in the place of missing ids; written if there are any, so that a row
    has one number for the whole stage."""
    if not docs.where("doc_id IS NULL").limit(1).count():
        return docs.select(*COLUMNS)
    number = F.lit(_UNNAMED) + F.monotonically_increasing_id()
    return written(docs.withColumn("doc_id", F.coalesce("doc_id", number)).select(*COLUMNS))


def _as_they_came(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.when(F.col("doc_id") < _UNNAMED, F.col("doc_id"))).select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    """Documents that still have a word, with their new length."""
    left = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    docs = _named(docs)
    judged = site_quality.classify(docs, _table(spark, sf_dir, "labels"))
    good = judged.where("kept").select("doc_id").distinct()
    return _as_they_came(docs.join(good, "doc_id", "left_semi"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return _as_they_came(jaccard_join.one_per_component(_named(docs), NEAR))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of repeated strings go, and documents that are left empty."""
    docs = _named(docs)
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    named = docs.drop("text").join(cut.select("doc_id", F.col("kept").alias("text")), "doc_id")
    return _as_they_came(_with_text(named))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: hit words go, and documents that are left empty."""
    benchmark = _table(spark, sf_dir, "benchmark")
    return _with_text(decontaminate.remove_contamination(docs.select(*COLUMNS), benchmark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids and the text decoded from them."""
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", encode),
]

#: The trained classifier and the tokenizer can't be put into SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
