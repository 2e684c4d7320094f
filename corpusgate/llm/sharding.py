"""Sharding by extendible hashing.

Every row has a hash of 60 bits. The directory starts with one bucket; a bucket whose bytes exceed the limit splits
on the next bit, and only such buckets do, until each fits. Sizes are summed once by a prefix of `step` bits and
rolled up to every shorter prefix, so all splits within `step` bits need one pass over the rows; only rows of buckets
that are still too large go another round with longer prefixes.

A shard is named by its bits ("" for the only bucket). Rows with equal hashes (a repeated key) can't be told apart by
more bits: if they are too large together, or a single row is, their bucket stays too large and is marked so. A null
text has 0 bytes; a null key is hashed as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import materialised

BITS = 60
#: Prefix bits that one round looks at: 65,536 sums for each bucket that it splits, at most.
STEP = 16
LIMIT = 64 << 20
#: Leaves up to this many, of some 100 bytes, are broadcast to the rows; more are joined by a shuffle on their first bits.
BROADCAST_LEAVES = 100_000


def _prefix(code: Column, bits: int) -> Column:
    return F.substring(code, 1, bits)


def hash_code(*keys: str) -> Column:
    """60 hash bits as a string of 0 and 1."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\\0")) for k in keys])), 1, BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), BITS, "0")


def directory(sizes: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """bits, depth, bytes, rows, oversized: the leaves, from rows with code and bytes."""
    leaves, open_rows, depth = None, sizes, 0
    while True:
        deep = min(depth + step, BITS)
        sums = open_rows.groupBy(_prefix(F.col("code"), deep).alias("deep")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("code").alias("low"), F.max("code").alias("high")
        )
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deep)))
        nodes = sums.select(levels.alias("depth"), "deep", "bytes", "rows", "low", "high")
        nodes = nodes.groupBy("depth", F.expr("substring(deep, 1, depth)").alias("bits")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        nodes = materialised(nodes.withColumn("closed", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))), "shard-nodes")
        # A leaf is closed, and its parent isn't. The round's first level has no parent here: it was open before.
        parents = nodes.filter(~F.col("closed")).select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("parent"))
        under = nodes.withColumn("parent", F.expr("substring(bits, 1, depth - 1)"))
        found = under.join(parents, ["depth", "parent"], "left_semi").drop("parent")
        found = found.unionByName(nodes.filter(F.col("depth") == depth)) if depth == 0 else found
        done = found.filter((F.col("closed")) | (F.col("depth") == BITS))
        leaves = done if leaves is None else leaves.unionByName(done)
        still = nodes.filter((F.col("depth") == deep) & ~F.col("closed")).select(F.col("bits").alias("deep"))
        if deep == BITS or still.isEmpty():
            break
        open_rows = materialised(open_rows.withColumn("deep", _prefix(F.col("code"), deep)).join(still, "deep", "left_semi").drop("deep"), "shard-rows")
        depth = deep
    return leaves.select("bits", "depth", "bytes", "rows", (F.col("bytes") > limit).alias("oversized"))


def shards(docs: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("doc_id", "text"), size: str = "text", step: int = STEP) -> DataFrame:
    """The rows of docs with shard, shard_bytes and oversized added; docs is read twice. Up to BROADCAST_LEAVES leaves its texts aren't shuffled.

    Columns of docs by these names are replaced."""
    coded = docs.drop("shard", "shard_bytes", "oversized").withColumn("code", hash_code(*keys))
    sizes = materialised(coded.select("code", F.coalesce(F.octet_length(F.col(size).cast("string")), F.lit(0)).cast("bigint").alias("bytes")), "shard-sizes")
    leaves = materialised(directory(sizes, limit, step), "shard-leaves")
    leaves = leaves.select("bits", F.col("bytes").alias("shard_bytes"), "oversized")
    # A row belongs to the one leaf whose bits its code starts with. Leaves lie within a few bits of each other, so
    # few share the bits of the shallowest.
    shallow, n = leaves.agg(F.coalesce(F.min(F.length("bits")), F.lit(0)), F.count(F.lit(1))).first()
    leaves = leaves.withColumn("first_bits", _prefix(F.col("bits"), shallow))
    leaves = F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves
    coded = coded.withColumn("code_bits", _prefix(F.col("code"), shallow))
    joined = coded.join(leaves, (F.col("code_bits") == F.col("first_bits")) & F.col("code").startswith(F.col("bits")))
    return joined.withColumnRenamed("bits", "shard").drop("code", "code_bits", "first_bits")
