"""Policy documents: the table of classes in their headings, its rules, and the difference of two versions.

`docs` has key columns and text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.functions.text import explode_lines

#: What a policy must have.
TIERS = ["Blocking", "Escalate", "Graded", "Advisory"]
REQUIRED_CLASSES = [f"{letter}{n}" for letter, most in (("Q", 14), ("M", 18), ("C", 3), ("D", 6)) for n in range(1, most + 1)]
REQUIRED_TEXTS = ["VERDICT: APPROVE | BLOCK | NEEDS-HUMAN", "RISK:", "RISK (partial):", "VERDICT_JSON:", '"schema_version"']
HEADING = "^### ([QMCD][0-9]+) "
TIERED = "^### ([QMCD][0-9]+) ([^()]+) \\(([A-Za-z]+)( \\+script)?\\)$"
MAX_WIDTH = 120
MAX_BYTES = 32 * 1024
CASES = "eval/cases/"


def _headings(docs: DataFrame, key: list[str]) -> DataFrame:
    lines = explode_lines(docs, key, HEADING)
    part = lambda n: F.regexp_extract("line_text", TIERED, n)
    rows = lines.select(
        *key, "line", "line_text", F.regexp_extract("line_text", HEADING, 1).alias("class_id"), F.trim(part(2)).alias("name"), part(3).alias("tier"), (part(4) != "").alias("has_script")
    )
    return rows.withColumn("valid", F.col("tier").isin(TIERS))


def parse_classes(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, class_id, name, tier, has_script; of headings that repeat a class, the last holds."""
    rows = _headings(docs, key).filter("valid")
    last = F.max_by(F.struct("name", "tier", "has_script"), "line").alias("c")
    return rows.groupBy(*key, "class_id").agg(last).select(*key, "class_id", "c.*")


def class_violations(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, violation: classes that repeat, headings without a valid tier, and missing classes."""
    rows = _headings(docs, key)
    turn = F.row_number().over(Window.partitionBy(*key, "class_id").orderBy("line"))
    twice = rows.withColumn("turn", turn).filter("turn > 1").select(*key, F.concat(F.lit("duplicate class: "), "class_id").alias("violation"))
    loose = rows.filter("not valid").select(*key, F.concat(F.lit("class heading without a valid tier: "), "line_text").alias("violation"))
    wanted = docs.select(*key, F.explode(F.array(*[F.lit(c) for c in REQUIRED_CLASSES])).alias("class_id"))
    missing = wanted.join(rows, [*key, "class_id"], "left_anti").select(*key, F.concat(F.lit("missing class: "), "class_id").alias("violation"))
    return twice.unionByName(loose).unionByName(missing)


def structure_violations(docs: DataFrame, key: list[str]) -> DataFrame:
    texts = F.filter(F.array(*[F.lit(t) for t in REQUIRED_TEXTS]), lambda t: ~F.contains(F.col("text"), t))
    absent = docs.select(*key, F.explode(texts).alias("t")).select(*key, F.concat(F.lit("missing required text: "), "t").alias("violation"))
    # Headings end at line feeds only.
    found = docs.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit("(?m)^#{2,3} .+$"), F.lit(0))).alias("place", "heading"))
    turn = F.row_number().over(Window.partitionBy(*key, "heading").orderBy("place"))
    twice = found.withColumn("turn", turn).filter("turn > 1").select(*key, F.concat(F.lit("duplicate heading: "), "heading").alias("violation"))
    return absent.unionByName(twice)


def in_code(line: Column, state: Column) -> tuple[Column, Column]:
    """Whether a line is fenced or a fence, and the fence that is open after it ("" for none).

    A fence closes on its own character, at least as long, with nothing after it."""
    marker = F.regexp_extract(line, "^\\s*(`{3,}|~{3,})", 1)
    bare = F.trim(F.regexp_extract(line, "^\\s*(?:`{3,}|~{3,})(.*)$", 1)) == ""
    opened = state == ""
    closes = (F.substring(marker, 1, 1) == F.substring(state, 1, 1)) & (F.length(marker) >= F.length(state)) & bare & (marker != "")
    return ~opened | (marker != ""), F.when(opened, marker).when(closes, "").otherwise(state)


def unfenced(lines: Column) -> Column:
    """array<struct<line, text>> of the lines outside of fences."""
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<line:int,text:string>>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        code, fence = in_code(line, acc["fence"])
        n = acc["n"] + 1
        out = F.when(code, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(n.alias("line"), line.alias("text")))))
        return F.struct(fence.alias("fence"), out.alias("out"), n.alias("n"))

    return F.aggregate(lines, start, step)["out"]


def line_violations(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, violation: wide lines and dashes in prose, outside of fences, tables and comments."""
    from corpusgate.functions.text import splitlines

    rows = docs.select(*key, F.explode(unfenced(splitlines(F.col("text")))).alias("l")).select(*key, "l.*")
    bare = F.trim("text")
    rows = rows.filter(~bare.rlike("^(\\||<!--)") & ~bare.endswith("-->"))
    wide = rows.filter((F.length("text") > MAX_WIDTH) & ~F.col("text").rlike("^(\\||VERDICT_JSON:)"))
    wide = wide.select(*key, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(f" exceeds {MAX_WIDTH} characters")).alias("violation"))
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^\\s+", ""), "`[^`]*`", ""), "^- ", "")
    dash = rows.filter(prose.rlike("\\s--?-?\\s|\\s--?-?$"))
    return wide.unionByName(dash.select(*key, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" uses a prose dash")).alias("violation")))


def encoding_violations(docs: DataFrame, key: list[str]) -> DataFrame:
    found = F.array_compact(
        F.array(
            F.when(F.octet_length("text") > MAX_BYTES, f"policy exceeds {MAX_BYTES} bytes"),
            F.when(F.contains(F.col("text"), F.lit("\r")), "policy must use LF line endings"),
            F.when(F.col("text").rlike("[^\\x00-\\x7F]"), "policy must contain ASCII text only"),
        )
    )
    return docs.select(*key, F.explode(found).alias("violation"))


def compare_policies(base: DataFrame, head: DataFrame, key: list[str]) -> DataFrame:
    """key, class_id, kind, old, new: what differs between two tables of classes of the same keys."""
    both = base.alias("b").join(head.alias("h"), [*key, "class_id"], "full_outer")
    old, new = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"h.{c}"))

    def change(when: Column, kind: str, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("old"), b.cast("string").alias("new")))

    null = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            change(new("tier").isNull(), "removed", old("tier"), null),
            change(old("tier").isNull(), "added", null, new("tier")),
            change(old("tier") != new("tier"), "tier", old("tier"), new("tier")),
            change(old("has_script") != new("has_script"), "script", old("has_script"), new("has_script")),
            change(old("name") != new("name"), "renamed", old("name"), new("name")),
        )
    )
    return both.select(*key, "class_id", F.explode(found).alias("c")).select(*key, "class_id", "c.*")


def eval_case_required(diff: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """key, violation: units with a change that isn't a renaming, without a changed evaluation case."""
    needs = diff.filter("kind <> 'renamed'").select(*key).distinct()
    covered = changed.filter(F.col("path").startswith(CASES)).select(*key)
    return needs.join(covered, key, "left_anti").withColumn("violation", F.lit("class or tier changes need a changed evaluation case"))


def class_table(spark: SparkSession, classes: Iterator | pd.DataFrame) -> DataFrame:
    """A table of classes from rows (class_id, name, tier, has_script)."""
    return spark.createDataFrame(classes, "class_id string, name string, tier string, has_script boolean")
