"""A corpus pipeline of the operators in corpusgate.llm: each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm import decontamination, langid, mixing, neardup, sharding
from corpusgate.llm.common import shared_folder
from corpusgate.llm.queries import SHARD_BYTES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if less than this share of its letters is in one language.
LEAST_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, and those of which no language has LEAST_SCORE."""
    model = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; repeated rows are such a group."""
    return neardup.first_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.scan(docs.select(*COLUMNS), benchmark).filter(F.size("hits") == 0).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each copy that it takes."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, its bytes, and whether it is too large."""
    return sharding.shards(docs.select(*COLUMNS), SHARD_BYTES)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("near duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: SQL expresses neither the trained language model nor near-duplicate classes; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
