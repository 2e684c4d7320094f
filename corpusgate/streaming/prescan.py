"""Streams: findings of arriving files, and the newest head of each change set under review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgate.operators.findings import union
from corpusgate.operators.textscan import hardcoded_env, incomplete_markers, js_debug, suppressions

LINE_SCANS = (incomplete_markers, suppressions, js_debug, hardcoded_env)


def stream_findings(files: DataFrame, scans: tuple[Callable[[DataFrame], DataFrame], ...] = LINE_SCANS) -> DataFrame:
    """The stateless scans over a stream of files; the same functions as for a table."""
    return union([scan(files) for scan in scans])


def stream_prescan(files: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends findings of arriving files to Parquet, each batch once."""
    query = stream_findings(files).writeStream.outputMode("append").format("parquet")
    return query.option("path", path).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def distinct_heads(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Review events (pr, head, seq, at) without heads that were seen; the watermark bounds what is remembered."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["pr", "head"])


def stream_new_heads(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Appends pr and head of review events to Parquet, each head once for as long as it is remembered; a run goes on where the last one ended.

    A head is forgotten when the watermark, `late` behind the newest event, has passed its first event by `late`; events older than the watermark are
    dropped. So state holds the heads of about twice that time, not of all history."""
    query = distinct_heads(events, late).select("pr", "head").writeStream.outputMode("append").format("parquet")
    return query.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_heads(events: DataFrame) -> DataFrame:
    """pr, seq, head, seen: the newest head of each change set; an older one that arrives later doesn't replace it.

    State is a row for each change set, whatever the number of events."""
    newest = F.max(F.struct("seq", "head"))
    return events.groupBy("pr").agg(newest.alias("n"), F.count(F.lit(1)).alias("seen")).select("pr", "n.seq", "n.head", "seen")


def stream_latest_head(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives every batch's changed rows to `write`, in update mode."""
    return latest_heads(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
