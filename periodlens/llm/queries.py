"""Registered queries of the training-data operators, with their SQL where SQL can express them.

Each query is a thin digest of its operator over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fertility, htmlcut, langid, maxent, merkle, packing, pii, simhash, spans, substring, warc, whitening
from .common import read
from .sql import MERKLE_SQL, WARC_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlcut.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "n_tokens", *fertility.MEASURES, "reasons")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(read(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text tables as one: documents declare a language and a source; pages
    declare one in their markup and have an address."""
    docs = read(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text",
        F.col("lang").alias("declared"), F.lit(None).cast("string").alias("url"), F.col("source").alias("host"))
    pages = read(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.lit(None).cast("long").alias("doc_id"), "page_id", langid.visible_text("html").alias("text"),
        langid.markup_language("html").alias("declared"), "url", F.lit(None).cast("string").alias("host"))
    found = langid.identify(docs.unionByName(pages), "text", "declared", "url", "host", min_posterior=0.5)
    return found.select("origin", "doc_id", "page_id", "declared", *langid.RESULT, F.col("accepted").alias("kept"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), length=1024, end_id=2, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(read(spark, sf_dir, "documents"), run=3)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), min_score=0.5)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=32, scale=64, shift=1_000_000)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered={"text": text}).withColumn("folded_root", merkle.folded("altered"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest().alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


QUERIES: dict[str, Query] = {
    "op1_main_text": op1_main_text,
    "op2_language_model": op2_language_model,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_substrings": op5_substrings,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_warc": op13_warc,
}

ORACLE: dict[str, str] = {
    "op12_merkle": MERKLE_SQL,
    "op13_warc": WARC_SQL,
}
