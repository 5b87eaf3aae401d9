"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame. Each applies
its operator with production parameters to a whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import (
    bpe, decontaminate, fill_middle, html_text, jaccard_join, lm_scoring, prefix_trie, quality_rules,
    secret_ledger, site_quality, suffix_dedup, url_filter, warc,
)

from flowgauge.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    entries = warc.read_archives(spark, folder, payloads=False)
    return entries.where("error IS NULL").select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", warc.page_number("refers_to").alias("refers_to"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    n_hit = F.aggregate(
        "hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + F.lit(1).cast("long")
    )
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "soft_hits", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), held_out)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restore_texts(fill_middle.fill_middle(_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = secret_ledger.new_ledger(shared_folder(spark))
    found = secret_ledger.find_secrets(_table(spark, sf_dir, "documents"), folder)
    base = [rule.kind for rule in secret_ledger.BASE_RULES]

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("base", F.filter("found", lambda f: f["kind"].isin(base))).select(
        "doc_id", *map(count, base), F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("found").alias("spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_site_quality": op5_site_quality,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_text": op8_html_text,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_middle": op12_fill_middle,
    "op13_secret_ledger": op13_secret_ledger,
}
