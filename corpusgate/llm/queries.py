"""The queries of this subpackage, and what DuckDB answers where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm import alignment, decontamination, extraction, fingerprints, langid, licenses, mixing, neardup, oracles, periodic, secrets, sharding, tokencount, toxicity
from corpusgate.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


#: Bytes of a shard in op3 and the pipeline.
SHARD_BYTES = 8 << 20


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "shard_bytes", "oversized")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.counted(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary; the one that op6 counts with."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.limited(tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary()))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.counted(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    edited = docs.withColumn("text", periodic.made_periodic(F.col("doc_id"), F.col("text")))
    return periodic.digested(periodic.periodic_runs(edited))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.digested(alignment.align(docs, vocabulary(), vocabulary("piece_bpe_32k.model")).documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_mixing,
        op3_sharding,
        op4_langid,
        op5_secrets,
        op6_tokens,
        op7_licenses,
        op8_neardup,
        op9_decontamination,
        op10_extraction,
        op11_toxicity,
        op12_runs,
        op13_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op1_fingerprints": oracles.OP1,
    "op2_mixing": oracles.OP2,
    "op3_sharding": oracles.op3(SHARD_BYTES),
    "op5_secrets": oracles.OP5,
    "op7_licenses": oracles.OP7,
    "op8_neardup": oracles.OP8,
    "op9_decontamination": oracles.OP9,
}
