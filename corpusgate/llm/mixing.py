"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated for as many epochs as its target may ask for. A
copy of a document has a virtual start and finish time: the words of its source before it, and with it, divided by
the source's target in whole words, which is its weight. Copies are put in ranges of virtual time, RANGES to the time in which
every source gets its target. The words of each range add up to running totals over all sources, and the mix ends with the
last range that the total budget, the sum of the targets, still pays for. A copy of which words lie on both sides is cut there.

Cumulative words of a source come from two levels: sums of ranges of the shuffled order (as many as the square root of the
source's documents), then a running sum inside each range, so that a source with a third of all rows is spread over
many tasks. Null or word-less texts have size 0 and give no words. A null source is a source of its own, the last. Repeated
rows each have their place in the queue, next to each other in order of doc_id and size; the place of a row without a doc_id
comes from its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import SPACED, discard, materialised, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1|"
#: Ranges of virtual time.
RANGES = 64
#: Sources up to this many are broadcast with their few numbers; more are joined by shuffles.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(SPACED)).cast("bigint")


def sized(docs: DataFrame, seed: str = SEED, *keep: Column) -> DataFrame:
    """doc_id, source, size and place, the document's place in [0, 1) of the shuffled order, and what is to be kept."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text|"), text_or_empty()))
    digest = F.md5(F.concat(F.lit(seed), named))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words(text_or_empty()).alias("size"), place.alias("place"), *keep)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, docs, source_size, target: one row for each source, from its documents' sizes.

    Sources by code point, null last, weigh as `weights` says, repeated. Targets are `share` times all words, dealt
    by weight; none is above `epochs` times its source's words, the excess being dealt again by weight. That is a
    water level: with sources in the order in which they fill up (limit divided by weight), a source is full if the
    level that would just fill it needs no more than the budget."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    by = by.withColumn("filled", F.sum("limit").over(before) - F.col("limit"))
    by = by.withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(before) + F.col("weight"))
    by = by.withColumn("full", F.col("limit") / F.col("weight") * F.col("open") + F.col("filled") <= F.col("budget"))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0))
    level = (F.col("budget") - spent) / rest
    return by.select(
        "source",
        "docs",
        "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level).alias("target"),
    )


def queued(sizes: DataFrame, by: DataFrame) -> DataFrame:
    """The rows of sizes, which has the columns of `sized`, with source_size, target, weight (the target in whole words) and upto, the
    words of the row's source up to it."""
    ranges, weight = F.ceil(F.sqrt(F.col("docs").cast("double"))), F.round("target").cast("bigint")
    by = by.select(F.col("source").alias("of"), "source_size", "target", weight.alias("weight"), ranges.alias("ranges"))
    joined = sizes.join(by, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    joined = joined.withColumn("range", F.floor(F.col("place") * F.col("ranges")))
    totals = joined.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    below = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(
        F.col("source").alias("of"), F.col("range").alias("at"), (F.sum("range_size").over(below) - F.col("range_size")).alias("before")
    )
    inside = (
        Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = joined.withColumn("inside", F.sum("size").over(inside))
    placed = running.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    return placed.withColumn("upto", F.col("before") + F.col("inside")).drop("before", "inside", "range", "ranges", "of", "at", "place")


def _end(copy: Column | int) -> Column:
    """Words of the source up to the end of a row's copy."""
    return copy * F.col("source_size") + F.col("upto")


def _copies(queue: DataFrame, epochs: int) -> DataFrame:
    """A row for each document and epoch, with end, its last word in its source's queue, and finish, when that is served."""
    copies = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("end", _end(F.col("copy")))
    return copies.withColumn("finish", F.when(F.col("weight") > 0, F.col("end") / F.col("weight")).otherwise(F.lit(0.0)))


def totals(copies: DataFrame) -> DataFrame:
    """range, size, upto: the words of the copies by the range of virtual time in which they are served, and up to it.

    A copy counts in each range that it reaches into. Ranges beyond twice the time that the budget lasts are one."""
    last = 2 * RANGES
    of_word = lambda k: F.least(F.expr(f"({k} * {RANGES}L + weight - 1) div weight"), F.lit(last))
    served = copies.filter("size > 0 and weight > 0").select("end", "size", "weight", F.explode(F.sequence(of_word("(end - size + 1)"), of_word("end"))).alias("range"))
    upper = F.when(F.col("range") < last, F.least(F.col("end"), F.expr(f"range * weight div {RANGES}L"))).otherwise(F.col("end"))
    lower = F.greatest(F.col("end") - F.col("size"), F.expr(f"(range - 1) * weight div {RANGES}L"))
    by = served.groupBy("range").agg(F.sum(upper - lower).alias("size"))
    return by.withColumn("upto", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _queue(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: str, *keep: Column) -> tuple[DataFrame, int]:
    """The documents in their queues, and the last range that the budget pays for."""
    sizes = materialised(sized(docs, seed, *keep), "mix-sizes")
    by = materialised(targets(sizes, weights, share, epochs), "mix-targets")
    whole = by.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum(F.round("target").cast("bigint")), F.lit(0)).alias("budget")).first()
    queue = materialised(queued(sizes, F.broadcast(by) if whole.sources <= BROADCAST_SOURCES else by), "mix-queue")
    paid = totals(_copies(queue, epochs)).filter(F.col("upto") <= whole.budget).agg(F.max("range").alias("range")).first().range
    discard(sizes, by)
    return queue, paid or 0


def _taken(end: Column, paid: int) -> Column:
    """Words of a copy in ranges up to the last one paid for."""
    served = F.expr(f"{paid}L * weight div {RANGES}L") if paid < 2 * RANGES else end
    return F.greatest(F.lit(0), F.least(F.col("size"), served - (end - F.col("size"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copy, finish, taken: a row for each document and epoch, then the columns in keep.

    finish is the copy's virtual finish time; copies with taken > 0, in order of finish, are the mix. Copies that the
    mix doesn't reach have taken 0."""
    queue, paid = _queue(docs, weights, share, epochs, seed, *keep)
    rows = _copies(queue, epochs).withColumn("taken", _taken(F.col("end"), paid))
    kept = rows.drop("doc_id", "source", "size", "source_size", "target", "weight", "upto", "copy", "end", "finish", "taken").columns
    return rows.select("doc_id", "source", "size", "source_size", "target", "copy", "finish", "taken", *kept)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of docs that it takes, a row for each copy, range-sorted by virtual finish time.

    A copy that is cut at the end of the budget comes whole. Of rows that are equal in all columns, one is dealt to the
    copies that the mix takes of any of them."""
    given = docs.drop("mix_copy", "mix_finish", "mix_a", "mix_b")
    row = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in given.columns]
    keys = [F.xxhash64(*row).alias("mix_a"), F.hash(*row).alias("mix_b")]
    taken = mix(given, keep=tuple(keys), **settings).filter("taken > 0")
    taken = taken.select("mix_a", "mix_b", F.col("copy").alias("mix_copy"), F.col("finish").alias("mix_finish"))
    rows = given.select("*", *keys).dropDuplicates(["mix_a", "mix_b"]).join(taken, ["mix_a", "mix_b"])
    return rows.drop("mix_a", "mix_b").orderBy("mix_finish", "doc_id", "mix_copy")


def shares(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs with the words that the mix takes of it."""
    queue, paid = _queue(docs, weights, share, epochs, seed)
    taken = sum((_taken(_end(i), paid) for i in range(1, epochs)), _taken(_end(0), paid))
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
