"""Work for every core where a table comes in few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt anew if it has fewer splits than there are cores.

    A large table has more splits than that and passes unchanged. Not for results of other steps: asking those for
    their partitions would run them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
