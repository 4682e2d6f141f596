"""Registered queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm import ann, decontaminate, jaccard_join, licenses, merkle, minhash, mixing, oracles, phrases, quality, range_coder, secrets, toxicity, warc
from cellmosaic.llm.common import lower_ascii, read_table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the SQL's rule; the pipeline's mix goes on until nothing fits
    return mixing.mix(read_table(spark, sf_dir, "documents"), go_on=False).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(read_table(spark, sf_dir, "pages"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_every(read_table(spark, sf_dir, "embeddings"), 100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def token_vocabulary() -> str:
    """Where the public tokenizer file lies; the same path on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.tokenize(read_table(spark, sf_dir, "documents"), token_vocabulary())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.concat("base", "linked")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["family"] != "unknown")
    return found.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("bigint").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("bigint").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(sure["family"])), ",").alias("families"), "score",
        F.to_json("found").alias("found"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(
        read_table(spark, sf_dir, "documents"), F.when(tampered, merkle.leaf_digest(text=lower_ascii(F.col("text")))))
    rebuilt = merkle.folded(F.coalesce("seen_leaf", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        rebuilt.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_nearest": op3_nearest,
    "op4_quality": op4_quality,
    "op5_token_ids": op5_token_ids,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_licenses": op10_licenses,
    "op11_minhash": op11_minhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrases": op13_phrases,
}
ORACLES = {
    "op1_source_mix": oracles.SOURCE_MIX,
    "op2_warc_revisits": oracles.WARC_REVISITS,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op11_minhash": oracles.NEAR_DUPLICATES,
    "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
    "op13_phrases": oracles.PHRASES,
}
