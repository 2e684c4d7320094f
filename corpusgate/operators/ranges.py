"""Work on units that are too large for one task: ranks and packing by ranges of the order.

Rows are dealt to ranges of (unit, order) and written once, each with its range. What ranges have to tell each other is a few rows for each of them:
a range begins inside one unit at most, so there are fewer such rows than ranges."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.shared import shared_folder
from corpusgate.functions.ship import ship
from corpusgate.operators import packing

#: Binary logarithm of the most rows of a range that is worked on as a whole: 131,072 rows, some 30 MB of a worker.
BITS = 17


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the shared folder: what reads them again computes nothing anew."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.written_to = path
    return out


def dealt(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows in the shared folder as `written` has them, in as many buckets of key as shuffles have partitions: groups and windows over the key
    read them without dealing them anew."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    rows.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).saveAsTable(table)
    out = spark.table(table)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ranged(rows: DataFrame, key: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """Rows dealt to ranges of key and order, each sorted."""
    by = [*key, *order]
    return (rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)).sortWithinPartitions(*by)


def numbered(sorted_rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of `ranged` with range and __row, their place in it from 0: partitions are cut into ranges of 2^bits rows at most, so that these don't grow
    with the table. first tells a range's first row."""
    rows = sorted_rows.withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("range", F.shiftright("__at", bits)).withColumn("__row", F.col("__at").bitwiseAND(F.lit(2**bits - 1)).cast("int"))
    return rows.withColumn("first", F.col("__row") == 0).drop("__at")


def ranked(rows: DataFrame, key: list[str], order: list[Column | str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """rows with their number, from 1, in each unit of key, as row_number over the unit gives it; the order must leave no ties.

    A unit may go over any number of ranges: ranks within a range are counted as rows pass by, and the rows that earlier ranges hold of the unit with
    which a range begins are added to them."""
    ship(rows.sparkSession)
    n = len(key)
    columns = [c for c in rows.columns if c not in key]
    first = [*key, *columns]
    numbers = rows.select(*first).withColumn("__rank", F.lit(0).cast("bigint")).withColumn("__first", F.lit(False))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rank, beginning = None, 0, True
        for batch in batches:
            ranks, firsts = [], []
            for this in zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True):
                if this != unit:
                    beginning = beginning and unit is None
                    unit, rank = this, 0
                rank += 1
                ranks.append(rank)
                firsts.append(beginning)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64()), pa.array(firsts, pa.bool_())], [*batch.schema.names, "__rank", "__first"])

    schema = numbers.schema
    for field in schema.fields:
        field.nullable = True
    placed = ranged(rows.select(*first), key, order, ranges).mapInArrow(counted, schema).withColumn("__range", F.spark_partition_id())
    placed = written(placed, name)
    held = placed.groupBy(*key, "__range").agg(F.max("__rank").alias("n"))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range that begins inside a unit, so fewer than there are ranges.
    offsets = held.withColumn("before", F.sum("n").over(before)).filter("before is not null").select("__range", F.lit(True).alias("__first"), "before")
    rank = F.col("__rank") + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(offsets), ["__range", "__first"], "left").select(*rows.columns, rank.alias(name))


class _Units:
    """Of the units that go over several ranges: their ranges and the sizes at which these begin, and their whole sizes."""

    def __init__(self, totals: list) -> None:
        self.begins: dict[str, list[int]] = {}
        self.ranges: dict[str, list[int]] = {}
        self.ends: dict[str, int] = {}
        for row in totals:
            begin = self.ends.get(row.unit, 0)
            self.begins.setdefault(row.unit, []).append(begin)
            self.ranges.setdefault(row.unit, []).append(row.range)
            self.ends[row.unit] = begin + row.total

    def begin(self, unit: str, number: int) -> int:
        return self.begins[unit][self.ranges[unit].index(number)] if unit in self.begins else 0

    def range_at(self, unit: str, size: int) -> int:
        """The range of the file in which a size above what came before falls; ranges of no size hold none."""
        return self.ranges[unit][bisect_right(self.begins[unit], size) - 1]


def _cuts(table: pa.Table) -> np.ndarray:
    """Where the rows of each unit begin in a range that is sorted, and its end."""
    units = table.column("unit").combine_chunks()
    changed = pc.not_equal(units[1:], units[:-1]).to_numpy(zero_copy_only=False) if len(units) > 1 else np.zeros(0, bool)
    return np.array([0, *(np.flatnonzero(changed) + 1).tolist(), len(units)] if len(units) else [0])


def _pieces(table: pa.Table) -> Iterator[tuple[str, int, int]]:
    """unit, begin and end of each unit's rows in a range that is sorted."""
    cuts = _cuts(table).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.column("unit")[a].as_py(), a, b


def _links(sizes: np.ndarray, begin: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The running sizes, and for a chunk that begins with each file where the next begins: the first file with which it would be above the limit."""
    ends = begin + np.cumsum(sizes)
    return ends, np.searchsorted(ends, ends - sizes + limit, "right")


def pack_ranges(sizes: DataFrame, key: list[str], budget: Column | int, ranges: int | None = None, bits: int = BITS) -> DataFrame:
    """What `packing.pack_chunks` gives, for change sets of any length: no task holds more than a range of one, of 2^bits files at most.

    Next fit as links in a list: the chunk that begins with a file ends where the running size first exceeds that file's start by more than the budget,
    found by binary search, so each file links to the one with which the next chunk would begin. Within a range links are followed at once; those
    that leave it are told by the size at which they do. These links, and where each of them leaves the range it comes to, make a shorter list, of
    which the part that begins with a change set's first file is found by doubling: pairs of links become links, and what is reached grows twofold."""
    spark = sizes.sparkSession
    ship(spark)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    unit = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = sizes.select(*key, packing.file_order(sizes), "path", F.col("cost").cast("int").alias("cost"), limit.cast("bigint").alias("limit"), unit.alias("unit"))
    fits = F.coalesce(F.col("cost") <= F.col("limit"), F.lit(False))
    placed = written(numbered(ranged(rows.filter(fits), ["unit"], ["ord", "path", "cost"], ranges), bits), "pack-ranges")
    # A unit that goes over several ranges begins all of them but its first, so there are fewer such units than ranges.
    wide = placed.join(F.broadcast(placed.filter("first").select("unit").distinct()), "unit", "left_semi").select("unit", "range", "__row", "cost", "limit")
    totals = wide.groupBy("unit", "range").agg(F.sum("cost").alias("total"))
    several = F.count(F.lit(1)).over(Window.partitionBy("unit")) > 1
    # Units of several ranges have fewer than two rows for each range together.
    units = _Units(totals.withColumn("several", several).filter("several").orderBy("unit", "range").collect())
    shared = spark.sparkContext.broadcast(units)
    # Ranges meet what they are told in cogroups; as measured, these send rows to Python at about half the cost of groups.
    begins = [(unit, number, begin) for unit, numbers in units.ranges.items() for number, begin in zip(numbers, units.begins[unit], strict=True)]
    begun = spark.createDataFrame(begins, "unit string, range bigint, begin bigint")

    def ordered(table: pa.Table) -> pa.Table:
        """The range as it was sorted and cut: by the rows' places, so that nulls stand where Spark has them."""
        return table.sort_by("__row")

    def leaving(table: pa.Table, begun: pa.Table) -> pa.Table:
        """Where chunks that begin in this range may leave it, as (unit, size), with the range they come to."""
        known, table = shared.value, ordered(table)
        begin = dict(zip(begun.column("unit").to_pylist(), begun.column("begin").to_pylist(), strict=True))
        out: list[tuple[str, int, int]] = []
        for name, a, b in _pieces(table):
            if name not in begin:
                continue
            costs, most = table.column("cost")[a:b].to_numpy().astype(np.int64), table.column("limit")[a].as_py()
            ends, after = _links(costs, begin[name], most)
            beyond = np.unique((ends - costs + most)[after == len(ends)])
            out += [(name, int(size), known.range_at(name, int(size))) for size in beyond if size < known.ends[name]]
        names, at, to = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"unit": pa.array(names, pa.string()), "at": pa.array(at, pa.int64()), "range": pa.array(to, pa.int64())})

    arrivals = wide.groupBy("range").cogroup(begun.groupBy("range")).applyInArrow(leaving, "unit string, at bigint, range bigint").distinct()

    def linked(table: pa.Table, arrived: pa.Table) -> pa.Table:
        """From each arrival, and from the first file of a unit (-1), to where the range is left, with the chunks begun on the way."""
        known, table = shared.value, ordered(table)
        number = table.column("range")[0].as_py() if len(table) else 0
        asked: dict[str, list[int]] = {}
        for name, at in zip(arrived.column("unit").to_pylist(), arrived.column("at").to_pylist(), strict=True):
            asked.setdefault(name, []).append(at)
        out: list[tuple[str, int, int | None, int]] = []
        for name, a, b in _pieces(table):
            if name not in known.begins:
                continue
            costs, most = table.column("cost")[a:b].to_numpy().astype(np.int64), table.column("limit")[a].as_py()
            ends, after = _links(costs, known.begin(name, number), most)
            n = len(ends)
            last, steps = np.arange(n).tolist(), [1] * n
            for i in range(n - 1, -1, -1):
                j = int(after[i])
                if j < n:
                    last[i], steps[i] = last[j], steps[j] + 1
            for at in ([-1] if known.ranges[name][0] == number else []) + asked.get(name, []):
                i = 0 if at < 0 else int(np.searchsorted(ends, at, "right"))
                leaves = int(ends[last[i]] - costs[last[i]] + most)
                out.append((name, at, leaves if leaves < known.ends[name] else None, steps[i]))
        names, at, to, steps = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"unit": pa.array(names, pa.string()), "at": pa.array(at, pa.int64()), "to": pa.array(to, pa.int64()), "steps": pa.array(steps, pa.int64())})

    by_range = arrivals.withColumnRenamed("range", "comes")
    links = written(wide.groupBy("range").cogroup(by_range.groupBy("comes")).applyInArrow(linked, "unit string, at bigint, to bigint, steps bigint"), "pack-links")
    chain, reached = links, links.filter("at = -1").select("unit", "at", F.lit(0).cast("bigint").alias("before"))
    longest = max(map(len, units.ranges.values()), default=1)
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = reached.join(chain, ["unit", "at"]).filter("to is not null").select("unit", F.col("to").alias("at"), (F.col("before") + F.col("steps")).alias("before"))
        last = [x for x in (reached, chain) if x is not links and hasattr(x, "written_to")]
        reached = written(reached.unionByName(further), "pack-reached")
        other = chain.select("unit", F.col("at").alias("to"), F.col("to").alias("end"), F.col("steps").alias("more"))
        chain = written(chain.join(other, ["unit", "to"]).select("unit", "at", F.col("end").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "pack-chain")
        discard(*last)
    # One chunk at most is the first to begin in a range of a unit, so these are no more rows than `units` has.
    starts: list[tuple[str, int, int, int | None, int]] = []
    found: dict[str, list[tuple[int, int, int]]] = {}
    for row in reached.join(links.select("unit", "at", "steps"), ["unit", "at"]).collect():
        found.setdefault(row.unit, []).append((row.at, row.before, row.steps))
    for name, numbers in units.ranges.items():
        by = {numbers[0] if at < 0 else units.range_at(name, at): (at, before, steps) for at, before, steps in found[name]}
        chunk = 0
        for number, begin in zip(numbers, units.begins[name], strict=True):
            at, before, steps = by.get(number, (None, 0, 0))
            starts.append((name, number, begin, at, chunk))
            chunk = chunk if at is None else before + steps
    started = spark.createDataFrame(starts, "unit string, range bigint, begin bigint, entry bigint, opened bigint")

    def packed(table: pa.Table, started: pa.Table) -> pa.Table:
        """All units of a range at once: links that would leave a unit go to where the next one begins."""
        table = ordered(table)
        cuts = _cuts(table)
        costs, most = table.column("cost").to_numpy().astype(np.int64), table.column("limit").to_numpy()
        ends, after = _links(costs, 0, most)
        after = np.minimum(after, np.repeat(cuts[1:], np.diff(cuts))).tolist()
        i, before = 0, np.zeros(len(cuts) - 1, np.int64)
        if len(table):
            # Only the first unit of a range may have begun in an earlier one.
            name = table.column("unit")[0].as_py()
            for told in (x for x in started.to_pylist() if x["unit"] == name):
                begin, entry, before[0] = told["begin"], told["entry"], told["opened"]
                i = int(cuts[1]) if entry is None else 0 if entry < 0 else int(np.searchsorted(begin + ends[: cuts[1]], entry, "right"))
        begun = np.zeros(len(table), bool)
        while i < len(after):
            begun[i] = True
            i = after[i]
        count = np.cumsum(begun)
        before -= count[cuts[:-1]] - begun[cuts[:-1]]
        chunks = (count + np.repeat(before, np.diff(cuts))).astype(np.int32)
        return table.select([*key, "ord", "path", "cost"]).append_column("chunk", pa.array(chunks))

    schema = placed.select(*key, "ord", "path", "cost").withColumn("chunk", F.lit(0)).schema
    for field in schema.fields:
        field.nullable = True
    done = placed.drop("first").groupBy("range").cogroup(started.groupBy("range")).applyInArrow(packed, schema)
    aside = rows.filter(~fits).select(*key, "ord", "path", "cost", F.lit(None).cast("int").alias("chunk"))
    return done.unionByName(aside).withColumn("oversized", F.col("chunk").isNull())
