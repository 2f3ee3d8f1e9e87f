"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contactlake.llm import (
    bpe, chat, decontam, linefreq, pii, repair, repeats, resample, sharding, simhash, tokens, toxicity, warc,
)
from contactlake.llm.common import table
from contactlake.llm.oracles import ORACLES  # noqa: F401
from contactlake.session import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = Scratch(spark, "tokens").path("store")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), codec).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_linefreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.line_quality(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat(m["start"], F.lit(":"), m["end"]))
    return rotated.select(
        "conv_id", "speaker", "block", "part", "n_turns", "text", F.array_join(spans, ",").alias("masks")
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    kinds = F.transform("strict", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}")
        for k in ("email", "ip", "card", "phone")
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.described(F.col("strict")).cast("binary"), 256).alias("base_sha256"),
        pii.described(F.col("spans")).alias("spans"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", repeats.removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damage(rows))
    given = rows.select(F.col("conv_id").alias("conv")).distinct()
    facts = repair.merge_facts(given, found.facts, repair.repaired_digests(found))
    counts = ("gaps", *repair.FAULTS, "illegal", "cost")
    return facts.select(
        F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    arc, archive = scratch.path("arc"), scratch.path("warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, archive, scratch.put("index", warc.index_arc(spark, arc)))
    return warc.read_archive(spark, archive).select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"),
    )


QUERIES: dict[str, Query] = {
    "op1_tokens": op1_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_bytebpe": op4_bytebpe,
    "op5_decontam": op5_decontam,
    "op6_simhash": op6_simhash,
    "op7_linefreq": op7_linefreq,
    "op8_chat": op8_chat,
    "op9_pii": op9_pii,
    "op10_repeats": op10_repeats,
    "op11_repair": op11_repair,
    "op12_resample": op12_resample,
    "op13_warc": op13_warc,
}
