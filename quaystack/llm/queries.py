"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystack.llm import (
    alignment, bpe, chat, divergence, exact_dedup, licenses, merkle, packing, pii, quality, simhash,
    token_counts, toxicity)
from quaystack.llm.common import documents, ready


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.grade(docs.select("doc_id", "text"), model).select(
        "doc_id", "severity", "grade", "p_toxic", "toxic")


def op2_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against its edited version and the next document."""
    ready(spark)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = (merkle.with_next_text(documents(spark, sf_dir))
            .withColumn("edited", F.concat(
                F.substring("text", F.lit(1), F.length("text") - half),
                F.substring("next_text", F.lit(1), half))))
    for text, tree in (("text", "own"), ("edited", "changed"), ("next_text", "other")):
        rows = merkle.with_tree(rows, text, tree)
    found = merkle.first_difference("own", "changed")
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own.root").alias("fingerprint"), F.col("changed.root").alias("edited_fingerprint"),
        merkle.likeness("own", "changed").alias("near_edited"),
        merkle.likeness("own", "other").alias("near_next"),
        found["paragraph"].alias("edit_paragraph"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both."""
    ready(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(documents(spark, sf_dir), *vocabulary)
    return bpe.decode(encoded, *vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans; ``spans`` also has the method's."""
    ready(spark)
    found = pii.find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept",
                       rows["sha256"].alias("text_sha256"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective; mask spans as ``start:end`` text."""
    ready(spark)
    parts = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.transform("mask", lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string")))
    return parts.withColumn("mask", F.array_join(mask, ","))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return divergence.audit(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_merkle_fingerprint, op3_byte_bpe, op4_simhash_near_dedup, op5_pii_crf,
        op6_packing, op7_exact_dedup, op8_quality_pu, op9_license_scan, op10_chat_rotation,
        op11_cross_tokenizer_alignment, op12_source_divergence, op13_token_counts)
}
