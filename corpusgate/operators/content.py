"""Reading trees and preparing their content: files, decoding, distinct blobs, evaluation cases.

`files` is repo, rev, path, blob_id, mode, content."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusgate.functions import filerules
from corpusgate.functions.ship import ship
from corpusgate.functions.text import in_skipped_folder
from corpusgate.operators.ranges import written

#: Bytes that a file counts for, beside its own, when files are only listed.
LISTED_AS = 65_536
_DECODED = "struct<text:string,error:string>"


def read_tree(spark: SparkSession, root: str, repo: str = "", rev: str = "head") -> DataFrame:
    """repo, rev, path, blob_id, mode, content of the files under a folder, without vendored and generated parts.

    Folders are listed first, without their files' contents, and only those that are kept are read. Their names pass through the driver, which holds
    the names of all files that Spark reads anyhow."""
    reader = spark.read.format("binaryFile")
    # Only names are asked for, so a task takes some thousand files; a session of its own keeps the setting from others.
    listing = spark.newSession()
    listing.conf.set("spark.sql.files.openCostInBytes", LISTED_AS)
    inner = "^.*?" + _quoted(root.rstrip("/")) + "/"
    listed = listing.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    within = F.regexp_replace(F.concat("folder", F.lit("/")), inner, "")
    folders = [r.folder for r in listed.filter(~in_skipped_folder(within)).select("folder").collect()]
    if any("=" in f.rpartition("/")[2] for f in folders):  # such a folder's name would be read as a column
        found = reader.option("recursiveFileLookup", "true").load(root)
    else:
        found = spark.read.format("binaryFile").load([_literal(f) for f in folders or [root]])
    below = F.regexp_replace("path", inner, "")
    rows = found.select(F.lit(repo).alias("repo"), F.lit(rev).alias("rev"), below.alias("path"), F.sha1("content").alias("blob_id"), F.lit("100644").alias("mode"), "content")
    return rows.filter(~in_skipped_folder(F.col("path")))


def _literal(folder: str) -> str:
    """A folder's name where patterns are taken."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", folder)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _decoder(mode: str, most: int | None):
    @F.pandas_udf(_DECODED)
    def decoded(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else filerules.decode(bytes(c), mode, most=most) for c in contents], columns=["text", "error"])

    return decoded


def decode_text(files: DataFrame, mode: str = "conflict", most: int | None = filerules.MAX_BYTES) -> DataFrame:
    """files with text and error in place of content. Larger files than `most` bytes are an error; None: no limit.

    Valid UTF-8 without a mark and without NUL, nearly all of a tree, is decoded by Spark; the helper sees the rest."""
    ship(files.sparkSession)
    head = F.hex(F.substring("content", 1, 3))
    plain = F.is_valid_utf8(F.col("content").cast("string")) & ~head.startswith("EFBBBF") & ~head.startswith("FFFE") & ~head.startswith("FEFF")
    plain = plain & ~F.contains(F.col("content").cast("string"), F.lit("\0"))
    plain = plain if most is None else plain & (F.length("content") <= most)
    odd = _decoder(mode, most)(F.when(~plain, F.col("content")))
    rows = files.withColumn("plain", plain).withColumn("odd", odd)
    text = F.when(F.col("plain"), F.col("content").cast("string")).otherwise(F.col("odd.text"))
    return rows.withColumn("text", text).withColumn("error", F.when(~F.col("plain"), F.col("odd.error"))).drop("plain", "odd", "content")


@F.pandas_udf(StringType())
def infer_bomless_utf(contents: pd.Series) -> pd.Series:
    """The encoding of UTF-16 and 32 without a mark, null for others."""
    return contents.map(lambda c: None if c is None else filerules.inferred_utf(bytes(c)))


def scan_distinct_blobs(files: DataFrame, dispatch: Column, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scans each distinct blob once for each way of scanning it, and gives every path that holds it the result.

    dispatch says how a path is scanned; scan takes and keeps blob_id and dispatch, and may look at one path of each."""
    rows = files.withColumn("dispatch", dispatch)
    distinct = rows.dropDuplicates(["blob_id", "dispatch"])
    found = scan(distinct)
    return rows.select("repo", "rev", "path", "blob_id", "dispatch").join(found, ["blob_id", "dispatch"])


class BlobStore:
    """Results of scans, kept from run to run by blob and way of scanning: a table bucketed by both, so that what is joined with it is dealt to its
    buckets and the table itself isn't shuffled."""

    def __init__(self, spark: SparkSession, path: str, result: str, buckets: int = 200) -> None:
        """path: a folder that is kept. result: the type of a finding, a struct. buckets stay as they were when the folder was first written."""
        self.spark = spark
        self.name = "blob_store_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (blob_id STRING, dispatch STRING, found ARRAY<{result}>) USING parquet "
            f"CLUSTERED BY (blob_id, dispatch) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, files: DataFrame) -> DataFrame:
        """One row for each blob and way of scanning that isn't kept. files has blob_id and dispatch."""
        rows = files.filter("blob_id is not null and dispatch is not null").dropDuplicates(["blob_id", "dispatch"])
        return rows.join(self.rows().select("blob_id", "dispatch"), ["blob_id", "dispatch"], "left_anti")

    def add(self, scanned: DataFrame) -> None:
        """scanned: blob_id, dispatch, found, an empty array for blobs without findings. Rows are kept once the job has ended."""
        scanned.select("blob_id", "dispatch", "found").write.insertInto(self.name)


def scan_new_blobs(files: DataFrame, dispatch: Column, scan: Callable[[DataFrame], DataFrame], store: BlobStore) -> DataFrame:
    """What `scan_distinct_blobs` gives, but only blobs that no earlier run has scanned are scanned; their results are added to the store.

    scan takes and keeps blob_id and dispatch; its other columns are those of the store's findings."""
    rows = files.withColumn("dispatch", dispatch)
    new = written(store.unseen(rows), "unseen-blobs")
    results = scan(new)
    fields = [c for c in results.columns if c not in ("blob_id", "dispatch")]
    each = results.groupBy("blob_id", "dispatch").agg(F.collect_list(F.struct(*fields)).alias("found"))
    none = F.array().cast(store.rows().schema["found"].dataType)
    store.add(new.select("blob_id", "dispatch").join(each, ["blob_id", "dispatch"], "left").withColumn("found", F.coalesce("found", none)))
    held = rows.select("repo", "rev", "path", "blob_id", "dispatch").join(store.rows(), ["blob_id", "dispatch"])
    return held.select("blob_id", "dispatch", "repo", "rev", "path", F.explode("found").alias("f")).select("blob_id", "dispatch", "repo", "rev", "path", "f.*")


def read_eval_cases(spark: SparkSession, root: str) -> DataFrame:
    """slug, expected (JSON text), context (empty without one), files (map of the others), one row for each folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -2).alias("slug"), F.element_at(parts, -1).alias("name"), F.col("content").cast("string").alias("text"))
    named = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    others = F.collect_list(F.when(~F.col("name").isin("expected.json", "context.md"), F.struct("name", "text")))
    return rows.groupBy("slug").agg(
        named("expected.json").alias("expected"),
        F.coalesce(named("context.md"), F.lit("")).alias("context"),
        F.map_from_entries(F.array_sort(others)).alias("files"),
    )
