"""Streams with state: heads that were seen, how long they are remembered, and what is left of the state."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from corpusgate.streaming import prescan as streams

SCHEMA = "pr bigint, head string, at timestamp"


def deliver(spark, folder, rows):
    values = spark.createDataFrame(rows, "pr bigint, head string, at string").withColumn("at", F.col("at").cast("timestamp"))
    values.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    query = streams.stream_new_heads(events, f"{folder}/new", f"{folder}/checkpoint", "1 hour")
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    return sorted(tuple(r) for r in spark.read.schema("pr bigint, head string").parquet(f"{folder}/new").collect()), held[-1] if held else 0


def test_heads_are_reviewed_once_and_forgotten_in_time(spark, tmp_path):
    day = "2024-01-01 "
    seen, held = deliver(spark, tmp_path, [(1, "a", day + "10:00:00"), (1, "a", day + "10:05:00"), (1, "b", day + "10:10:00"), (2, "a", day + "10:00:00")])
    assert (seen, held) == ([(1, "a"), (1, "b"), (2, "a")], 3)
    # After a restart: a repeated head, one from before the watermark (09:10), and a new one.
    seen, _ = deliver(spark, tmp_path, [(1, "a", day + "10:40:00"), (3, "late", day + "08:00:00"), (3, "new", day + "10:50:00")])
    assert seen == [(1, "a"), (1, "b"), (2, "a"), (3, "new")]
    # Time goes on: the old heads leave the state, and one that comes back then is reviewed anew.
    _, held = deliver(spark, tmp_path, [(9, "later", day + "15:00:00")])
    assert held <= 2
    seen, held = deliver(spark, tmp_path, [(1, "a", day + "15:10:00")])
    assert seen.count((1, "a")) == 2
    assert held == 2


def test_deliveries_have_as_many_files_as_splits(spark, tmp_path):
    """Four deliveries, however many splits the table has, and no task that takes a whole delivery."""
    from corpusgate.functions.shared import shared_folder
    from corpusgate.jobs.queries import flows

    rows = spark.range(60).selectExpr("id AS doc_id", "'r' AS source", "concat('TODO ', id) AS text")
    rows.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    before = set(Path(shared_folder(spark)).glob("arriving-*"))
    found = flows.stream_prescan(spark, str(tmp_path)).count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (folder,) = set(Path(shared_folder(spark)).glob("arriving-*")) - before
    assert len(list(folder.glob("*.parquet"))) == 12
    assert found > 0
