"""Queries of whole workloads and of streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.shared import shared_folder
from corpusgate.jobs import workloads
from corpusgate.jobs.queries.scans import SQL_DEBUG, SQL_ENV, SQL_MARKERS, SQL_SUPPRESSED
from corpusgate.operators import verdicts
from corpusgate.sources.synth import VIEWS, view, with_views
from corpusgate.streaming import prescan as streams


def prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample files as a change set for each repository: every file is new, and goes to the envelopes."""
    files = view(spark, sf_dir, "python_files").unionByName(view(spark, sf_dir, "web_files"))
    files = files.withColumn("ord", F.xxhash64("path").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    patch = F.concat(F.lit("@@ -0,0 +1 @@\n+"), F.regexp_replace("text", "\n(?!$)", "\n+"))
    changes = files.select("repo", "rev", "ord", "path", patch.alias("patch"), F.lit(False).alias("is_binary"), F.lit(True).alias("decodable"))
    by = changes.groupBy("repo", "rev").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    metadata = F.struct(F.col("repo").alias("repo"), F.lit("").alias("chunk"), F.array().cast("array<string>").alias("unreviewed"))
    prs = by.select("repo", "rev", "paths", metadata.alias("metadata"), F.lit("Title: all\n\n").alias("context"))
    made = workloads.prescan_changes(changes, files.select("repo", "rev", "path", "text"), prs, budget=20_000, chunks=None)
    per = made.prescan.groupBy("repo").agg(F.count(F.lit(1)).alias("findings"), F.count_if("blocking").alias("blocking"))
    chunks = made.envelopes.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"), F.sum("prescan_items").alias("items"), F.max("bytes").cast("bigint").alias("largest"))
    return chunks.join(per, "repo", "left")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of orders, one chunk each, to verdicts."""
    rows = view(spark, sf_dir, "reports").withColumn("chunk", F.lit(1))
    none = F.array().cast("array<string>")
    contexts = rows.select("pr", "chunk", "mode", F.array(F.lit("a.py"), F.lit("b.py")).alias("changed_files"), F.array(F.lit("P1")).alias("prescan_ids"), none.alias("unreviewed"))
    prescan = rows.filter("pr % 50 = 0").select("pr", F.lit(True).alias("blocking"))
    unreviewed = rows.filter("pr % 40 = 1").select("pr", F.lit("big.bin").alias("path"))
    out = workloads.gate_reports(rows.select("pr", "chunk", "text"), contexts, view(spark, sf_dir, "classes"), rows.select("pr").distinct(), prescan, unreviewed, ["pr"])
    return out.groupBy("verdict", "fails").agg(F.count(F.lit(1)).alias("prs"), F.sum("blocking_prescan").alias("blocking"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = spark.createDataFrame([("Ann", "ann@b.io")], "name string, email string")
    rows = workloads.audit(view(spark, sf_dir, "tree_files"), view(spark, sf_dir, "commits"), view(spark, sf_dir, "branches"), approved)
    return rows.groupBy("repo", "rule").agg(F.count(F.lit(1)).alias("violations"))


def _model(prompt: str, mode: str, envelope: str) -> str:
    """Stands in for a reviewer: right at once, right after the note, never right, or unavailable, by the envelope's number."""
    import json

    data = json.loads(envelope)
    k = data["k"] % 4
    if k == 3:
        raise TimeoutError("no answer")
    verdict = "APPROVE" if k == 0 or k == 1 and "RETRY" in data["TRUSTED_CONTEXT"] else "MAYBE"
    return f'VERDICT: {verdict}\nVERDICT_JSON: {{"schema_version": "1", "verdict": "{verdict}", "findings": []}}'


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of suppliers, reviewed by a function, with one retry."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey",
        F.lit("PR").alias("mode"),
        F.concat(F.lit('{"k": '), F.col("s_suppkey").cast("string"), F.lit(', "TRUSTED_CONTEXT": {}}')).alias("envelope"),
    )
    none = F.array().cast("array<string>")
    contexts = rows.select("s_suppkey", "mode", none.alias("changed_files"), none.alias("prescan_ids"), none.alias("unreviewed"))
    folder = f"{shared_folder(spark)}/reviews-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    out = verdicts.review_envelopes(rows, contexts, view(spark, sf_dir, "classes"), _model, "policy", ["s_suppkey"], written)
    return out.select("s_suppkey", "verdict", (F.col("report") != "").alias("has_report"), F.try_element_at("problems", F.lit(1)).alias("problem"))


def _streamed(spark: SparkSession, source: str, name: str, files: int = 1):
    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


DELIVERIES = 4


def stream_prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, taken as files, that arrive in several parts: the findings that the stream has appended."""
    folder = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    docs = view(spark, sf_dir, "doc_files").select("repo", "rev", "path", "text")
    # Files as the table has splits, a quarter of them in each delivery: no task holds a delivery.
    splits = max(spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    (docs if splits >= DELIVERIES else docs.repartition(DELIVERIES)).write.parquet(folder)
    files, out = _streamed(spark, folder, "stream-prescan", math.ceil(splits / DELIVERIES))
    streams.stream_prescan(files, f"{out}/findings", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(streams.stream_findings(spark.read.schema(files.schema).parquet(folder)).schema).parquet(f"{out}/findings")


def stream_latest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heads under review: the newest of each user after the whole stream."""
    folder = f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    head = F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string"))
    events.select(F.col("user_id").alias("pr"), head.alias("head"), F.col("event_id").alias("seq"), F.col("ts").alias("at")).repartition(3).write.parquet(folder)
    heads, out = _streamed(spark, folder, "stream-heads")
    last = f"{out}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{last}/batch={number}")

    streams.stream_latest_head(heads, write, f"{out}/checkpoint").awaitTermination()
    updates = spark.read.schema("pr bigint, seq bigint, head string, seen bigint").parquet(f"{last}/*")
    return updates.groupBy("pr").agg(F.max(F.struct("seq", "head", "seen")).alias("n"), F.max("seen").alias("seen")).select("pr", "n.seq", "n.head", "seen")


#: Longer than any table of events spans.
REMEMBERED = "4000 days"
#: Events as heads, in three deliveries by event_id; the last one repeats heads of the first and has heads from before the watermark.
VIEWS["head_events"] = """
SELECT user_id AS pr, event_type || '-' || CAST(event_id % 7 AS STRING) AS head, CAST(ts AS TIMESTAMP) AS at, CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END AS delivery FROM {events}
UNION ALL SELECT user_id, event_type || '-' || CAST(event_id % 7 AS STRING), CAST(ts AS TIMESTAMP), 2 FROM {events} WHERE event_id % 3 = 0 OR event_id % 5 = 1
UNION ALL SELECT user_id, 'late-' || CAST(event_id AS STRING), CAST(ts AS TIMESTAMP) - INTERVAL 9000 DAYS, 2 FROM {events} WHERE event_id % 4 = 0"""


def stream_new_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads to review, each once: two deliveries, a stop, and a third after the restart from the checkpoint."""
    folder = f"{shared_folder(spark)}/new-heads-{uuid.uuid4().hex}"
    events = view(spark, sf_dir, "head_events")
    kept = spark.read.schema("pr bigint, head string")
    for deliveries in ((0, 1), (2,)):
        for number in deliveries:
            events.filter(F.col("delivery") == number).drop("delivery").repartition(2).write.mode("append").parquet(f"{folder}/events")
        heads = spark.readStream.schema(events.drop("delivery").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
        streams.stream_new_heads(heads, f"{folder}/new", f"{folder}/checkpoint", REMEMBERED).awaitTermination()
    return kept.parquet(f"{folder}/new")


QUERIES = {
    "wa_prescan_to_envelopes": (prescan, None),
    "wb_reports_to_gate": (gate, None),
    "wc_tree_and_history_audit": (audit, None),
    "r8_review_envelopes": (
        reviewed,
        """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'APPROVE' ELSE 'NEEDS-HUMAN' END AS verdict, s_suppkey % 4 < 2 AS has_report,
          CASE s_suppkey % 4 WHEN 2 THEN 'unknown verdict token MAYBE' WHEN 3 THEN 'model call failed: no answer' END AS problem FROM supplier""",
    ),
    "x1_stream_prescan": (stream_prescan, with_views(" UNION ALL ".join([SQL_MARKERS, SQL_SUPPRESSED, SQL_DEBUG, SQL_ENV]), "doc_files")),
    "x2_stream_new_heads": (stream_new_heads, "SELECT DISTINCT user_id AS pr, event_type || '-' || CAST(event_id % 7 AS VARCHAR) AS head FROM events"),
    "x2_stream_latest_head": (
        stream_latest_head,
        "SELECT user_id AS pr, max(event_id) AS seq, arg_max(event_type || '-' || CAST(event_id % 7 AS VARCHAR), event_id) AS head, count(*) AS seen FROM events GROUP BY user_id",
    ),
}
