"""Ranks and packing over ranges, against a window or a walk over whole units; hot units, ties of sizes, nulls and empty tables."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgate.operators import findings, packing, ranges


def made_files(rng, units, most):
    rows = []
    for unit in range(units):
        for i in range(most if unit == 0 else rng.randint(0, 6)):
            rows.append((unit if unit % 5 else -unit, "r", i, f"p{i % 7}", rng.choice([0, 1, 2, 3, 5, 9, 30, None])))
    rng.shuffle(rows)
    return rows


def test_packing_by_ranges_is_next_fit(spark):
    rng = random.Random(4)
    for budget, most, parts in ((9, 600, 12), (40, 600, 30), (1, 60, 5), (100_000, 300, 9), (9, 0, 4), (30, 400, 1)):
        sizes = spark.createDataFrame(made_files(rng, 30, most), "pr int, repo string, ord int, path string, cost int").repartition(3)
        wanted = packing.pack_chunks(sizes, ["pr", "repo"], budget).collect()
        got = ranges.pack_ranges(sizes, ["pr", "repo"], budget, parts)
        assert got.columns == ["pr", "repo", "ord", "path", "cost", "chunk", "oversized"]
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted)), (budget, most, parts)


def test_ranges_are_cut_to_so_many_rows(spark):
    """However few partitions there are: a range that is worked on as a whole doesn't grow with the table."""
    rng = random.Random(8)
    rows = ranges.ranged(spark.range(5000).selectExpr("id % 3 AS unit", "id"), ["unit"], ["id"], 2)
    held = ranges.numbered(rows, 6).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("firsts")).collect()
    assert max(r.n for r in held) <= 64 and {r.firsts for r in held} == {1} and sum(r.n for r in held) == 5000
    for budget, most, parts in ((9, 600, 1), (100_000, 300, 2)):
        sizes = spark.createDataFrame(made_files(rng, 30, most), "pr int, repo string, ord int, path string, cost int").repartition(3)
        wanted = packing.pack_chunks(sizes, ["pr", "repo"], budget).collect()
        for bits in (3,):
            got = ranges.pack_ranges(sizes, ["pr", "repo"], budget, parts, bits)
            assert sorted(map(str, got.collect())) == sorted(map(str, wanted)), (budget, most, parts, bits)


def test_packing_with_a_budget_for_each_unit(spark):
    rng = random.Random(5)
    rows = [(*r, 5 + abs(r[0]) % 3 * 20) for r in made_files(rng, 12, 200)]
    sizes = spark.createDataFrame(rows, "pr int, repo string, ord int, path string, cost int, most int")
    wanted = packing.pack_chunks(sizes, ["pr", "repo"], F.col("most")).collect()
    assert sorted(map(str, ranges.pack_ranges(sizes, ["pr", "repo"], F.col("most"), 7).collect())) == sorted(map(str, wanted))
    assert ranges.pack_ranges(sizes.limit(0), ["pr", "repo"], 9, 4).count() == 0


def test_ranks_by_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b", "c"]), i, rng.choice([None, "x", "y"])) for i in range(3000)]
    table = spark.createDataFrame(rows, "unit string, n int, other string").repartition(5)
    wanted = table.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("n")).cast("bigint"))
    for parts in (1, 13):
        got = ranges.ranked(table, ["unit"], ["n"], ranges=parts)
        assert got.columns == ["unit", "n", "other", "rank"]
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert ranges.ranked(table.limit(0), ["unit"], ["n"]).count() == 0


def test_prescan_ids_of_a_hot_unit(spark):
    rows = spark.range(4000).selectExpr(
        "if(id % 2 = 0, 'hot', concat('r', id % 50)) AS repo", "concat('p', id % 97) AS path", "cast(id AS int) AS line", "if(id % 3 = 0, 'D2', 'M12') AS class_id", "'m' AS message", "true AS blocking"
    )
    wanted = findings.with_prescan_ids(rows, ["repo"])
    got = findings.with_prescan_ids(rows, ["repo"], hot=True)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_ranges_of_a_hot_unit_are_even(spark):
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', concat('r', id % 500)) AS repo", "id AS n")
    held = [r[1] for r in ranges.ranged(rows, ["repo"], ["n"], 16).groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) <= 2 * sorted(held)[len(held) // 2]


def test_caps_take_the_first_rows_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, 'cold', 'hot') AS repo", "id AS n")
    capped = findings.capped(rows, ["repo"], ["n"], 5, lambda full: full.selectExpr("repo", "-1L AS n"))
    assert "WindowGroupLimit" in capped._jdf.queryExecution().toString()
    assert capped.count() == 12


def test_places_above_an_int(spark):
    """Places of files keep the width that they come with, in packing, in ranges and where patches meet their chunk."""
    far = 54 * 10**8
    rows = [(*r[:2], far + r[2], *r[3:]) for r in made_files(random.Random(9), 12, 80)]
    sizes = spark.createDataFrame(rows, "pr int, repo string, ord bigint, path string, cost int")
    near = ranges.pack_ranges(sizes.withColumn("ord", (F.col("ord") - far).cast("int")), ["pr", "repo"], 40, 3)
    wanted = sorted(str((r.pr, r.ord + far, r.path, r.cost, r.chunk)) for r in near.collect())
    for got in (ranges.pack_ranges(sizes, ["pr", "repo"], 40, 3), packing.pack_chunks(sizes, ["pr", "repo"], 40)):
        assert got.schema["ord"].dataType.simpleString() == "bigint" and near.schema["ord"].dataType.simpleString() == "int"
        assert sorted(str((r.pr, r.ord, r.path, r.cost, r.chunk)) for r in got.collect()) == wanted
    packed = packing.limit_chunks(packing.pack_chunks(sizes, ["pr", "repo"], 40), None)
    found = spark.createDataFrame([], "pr int, repo string, path string, id string, line int, class_id string, message string, blocking boolean")
    chunks = packing._of_chunks(sizes.withColumn("patch", F.lit("+a")), packed, found, ["pr", "repo"]).collect()
    assert sorted((c.pr, f.ord) for c in chunks for f in c.rows) == sorted((r.pr, r.ord) for r in packed.filter("not oversized").collect())


def test_files_without_a_place_or_path(spark):
    """A range keeps the order by which it was cut: files without a place or path come first, as in the walk."""
    rng = random.Random(11)
    rows = [("u", rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([1, 2, 5, 9, 30])) for _ in range(400)]
    sizes = spark.createDataFrame(rows, "unit_of string, ord int, path string, cost int")
    wanted = packing.pack_chunks(sizes, ["unit_of"], 20).collect()
    for parts, bits in ((1, 17), (3, 4)):
        got = ranges.pack_ranges(sizes, ["unit_of"], 20, parts, bits)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted)), (parts, bits)


def test_linking_ranges_needs_no_places_or_paths(spark, monkeypatch):
    """What ranges tell each other is made of sizes alone: keys, places and paths don't go to Python for it."""
    seen, grouped = [], type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *by: (seen.append(set(self.columns)) if by == ("range",) and "cost" in self.columns else None, grouped(self, *by))[1])
    sizes = spark.createDataFrame(made_files(random.Random(3), 5, 200), "pr int, repo string, ord int, path string, cost int")
    ranges.pack_ranges(sizes, ["pr", "repo"], 30, 4)
    assert len(seen) == 3 and not (seen[0] | seen[1]) & {"pr", "repo", "ord", "path", "first"} and "first" not in seen[2]
