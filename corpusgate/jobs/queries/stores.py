"""Queries of what is kept between runs or read from folders: findings by unit, results by blob, trees of files; and of histories."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.functions.shared import shared_folder
from corpusgate.jobs.queries.scans import SQL_LINE_CHECKS, all_line_findings
from corpusgate.operators import commits, content, findings
from corpusgate.operators.ranges import written
from corpusgate.sources.synth import table, view, with_views


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def findings_written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written by repository and class in all three forms, then those of some repositories again, where markers are mended."""
    found = written(all_line_findings(spark, sf_dir), "found")
    scanned = view(spark, sf_dir, "doc_files").select("repo").distinct().filter("repo like '%1%'")
    again = found.filter("repo like '%1%' and class_id <> 'M12'")
    parts = []
    for form in ("json", "parquet", "text"):
        path = _folder(spark, f"findings-{form}")
        findings.write_findings(found, path, form, ["repo"])
        findings.write_findings(again, path, form, ["repo"], scanned)
        # Lines tell the class as well, which must be that of their folder.
        told = F.regexp_extract("value", "^.*:[0-9]+: ([A-Z0-9]+) ", 1) if form == "text" else F.col("class_id")
        kinds = "repo string, class string, " + ("value string" if form == "text" else "class_id string")
        rows = spark.read.schema(kinds).format(form).load(path)
        parts.append(rows.filter(told == F.col("class")).groupBy("repo", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.lit(form)))
    return findings.union(parts)


def blobs_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents are scanned, then all of them: the second run finds the first one's results in the store."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.lit("head").alias("rev"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("blob_id"), "text", "doc_id"
    )
    store = content.BlobStore(spark, _folder(spark, "blobs"), "STRUCT<hits: BIGINT>", 8)

    def scan(blobs: DataFrame) -> DataFrame:
        hits = F.regexp_count("text", F.lit("[Ll]icen[cs]e")).cast("bigint").alias("hits")
        return blobs.select("blob_id", "dispatch", hits).filter("hits > 0")

    content.scan_new_blobs(docs.filter("doc_id % 3 <> 0"), F.lit("text"), scan, store)
    return content.scan_new_blobs(docs, F.lit("text"), scan, store).select("repo", "path", "blob_id", "hits")


#: Folders of a tree, by doc_id modulo their number; the last two are skipped.
FOLDERS = ("src", "docs/a b", "web/node_modules/x", "vendor")


def _write_tree(docs: DataFrame, root: str) -> None:
    """A file for each row (k, value), in the folder of its k, as Spark's text writer has it.

    On a mounted folder tasks open the files themselves, all in one pass: there Spark's writer starts two programs for each file, to set the rights of
    it and of its checksum. A task that is run again writes the same names."""
    where = urlsplit(root)
    if where.scheme not in ("", "file"):
        for i, folder in enumerate(FOLDERS):
            docs.filter(F.col("k") == i).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/{folder}")
        return
    base = unquote(where.path) if where.scheme else root

    def wrote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in FOLDERS:
            os.makedirs(f"{base}/{folder}", exist_ok=True)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                with open(f"{base}/{FOLDERS[k.as_py()]}/part-{part:05}-{n:09}.txt", "wb") as file:
                    file.write(value.as_py().encode() + b"\n")
                n += 1
            yield batch.slice(0, 0)

    docs.filter(F.col("k").between(0, len(FOLDERS) - 1)).select("k", "value").mapInArrow(wrote, "k bigint, value string").write.format("noop").mode("overwrite").save()


def tree_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of a tree, a file each, and read again."""
    root = _folder(spark, "tree")
    kept = (F.col("doc_id") % len(FOLDERS)).cast("bigint").alias("k")
    _write_tree(table(spark, sf_dir, "documents").select(kept, F.coalesce("text", F.lit("")).alias("value")), root)
    files = content.read_tree(spark, root, "made")
    return files.select("repo", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.md5("content").alias("digest"))


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits in order of seq as a history that parts and merges; heads and remote refs near its end."""
    each = Window.partitionBy("repo").orderBy("seq")
    rows = view(spark, sf_dir, "commits").select("repo", "sha", "seq", F.row_number().over(each).alias("g"), F.count(F.lit(1)).over(Window.partitionBy("repo")).alias("n"))
    earlier = lambda k: F.lag("sha", k).over(each)
    parents = F.array_compact(F.array(F.when(F.col("g") % 6 == 5, earlier(3)).otherwise(earlier(1)), F.when(F.col("g") % 4 == 0, earlier(2))))
    history = rows.withColumn("parents", parents).select("repo", "sha", "parents", F.col("g").alias("generation"), (F.col("n") - F.col("g")).alias("left"))
    ref = lambda *places: history.filter(F.col("left").isin(*places)).select("repo", "sha")
    return history.drop("left"), ref(0, 3), ref(6, 9)


def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.unreachable_commits(*_history(spark, sf_dir))


_REACH = """, h AS MATERIALIZED (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY seq) AS g, count(*) OVER (PARTITION BY repo) AS n FROM commits),
e AS MATERIALIZED (SELECT repo, g, CASE WHEN g % 6 = 5 THEN g - 3 ELSE g - 1 END AS low FROM h UNION SELECT repo, g, g - 2 FROM h WHERE g % 4 = 0),
ours AS (SELECT repo, g FROM h WHERE n - g IN (0, 3) UNION SELECT e.repo, e.low FROM ours AS o JOIN e ON e.repo = o.repo AND e.g = o.g WHERE e.low > 0),
theirs AS (SELECT repo, g FROM h WHERE n - g IN (6, 9) UNION SELECT e.repo, e.low FROM theirs AS o JOIN e ON e.repo = o.repo AND e.g = o.g WHERE e.low > 0)
SELECT repo, sha FROM h WHERE (repo, g) IN (SELECT repo, g FROM ours) AND (repo, g) NOT IN (SELECT repo, g FROM theirs)"""
_ROWS = f"SELECT repo, class_id AS class, count(*) AS n FROM ({SQL_LINE_CHECKS}) WHERE repo NOT LIKE '%1%' OR class_id <> 'M12' GROUP BY ALL"
_FORMS = "(VALUES ('json'), ('parquet'), ('text')) AS f(form)"
QUERIES = {
    "s1_read_tree": (
        tree_read,
        "SELECT 'made' AS repo, CASE doc_id % 4 WHEN 0 THEN 'src' ELSE 'docs/a b' END AS folder, md5(coalesce(text, '') || chr(10)) AS digest FROM documents WHERE doc_id % 4 < 2",
    ),
    "s6_blobs_over_runs": (
        blobs_over_runs,
        "SELECT * FROM (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, md5(text) AS blob_id, CAST(len(regexp_extract_all(text, '[Ll]icen[cs]e')) AS BIGINT) AS hits FROM documents) WHERE hits > 0",
    ),
    "s9_write_findings": (findings_written_twice, with_views(f"SELECT r.*, form FROM ({_ROWS}) AS r, {_FORMS}", "doc_files")),
    "g8_unreachable_commits": (unreachable, with_views(_REACH, "commits").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n" + _REACH, _REACH)),
}
