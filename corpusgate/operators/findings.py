"""What scans share: the shape of a finding, the table of checks, order, ids and limits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.operators.ranges import ranked

#: A finding, after the columns that say which tree it is of.
FIELDS = ["path", "line", "class_id", "message", "blocking"]
#: Name, class, whether it blocks, whether it looks at a whole tree.
CHECKS = [
    ("regex", "Q3", False, False),
    ("dead-code", "Q5", False, False),
    ("iteration-mutation", "Q8", False, False),
    ("recursion", "Q9", False, False),
    ("resource-leak", "Q11", True, False),
    ("mutable-default", "Q13", False, False),
    ("empty-catch", "M1", True, False),
    ("magic-number", "M11", False, False),
    ("incomplete-work", "M12", True, False),
    ("suppressed-checks", "M13", True, False),
    ("broad-catch", "M16", False, False),
    ("debug-leftovers", "M17", False, False),
    ("hardcoded-env", "M18", False, False),
    ("untested-changes", "C3", False, True),
    ("unpinned", "D1", False, False),
    ("lockfile-drift", "D2", False, True),
    ("unused-deps", "D5", False, True),
]
PROJECT_CLASSES = [c for _, c, _, project in CHECKS if project]


def check_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKS, "name string, class_id string, blocking boolean, is_project boolean")


def finding(class_id: str, message: Column | str, blocking: bool, line: Column | str = "line") -> list[Column]:
    """The columns of a finding that come after its path."""
    text = F.lit(message) if isinstance(message, str) else message
    at = F.col(line) if isinstance(line, str) else line
    return [at.cast("int").alias("line"), F.lit(class_id).alias("class_id"), text.alias("message"), F.lit(blocking).alias("blocking")]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedupe(findings: DataFrame) -> DataFrame:
    """Equal findings of one tree count once; the order is for the reader, so it is left to `ordered`."""
    return findings.dropDuplicates()


def ordered(findings: DataFrame, key: list[str]) -> DataFrame:
    return findings.orderBy(*key, "path", "line", "class_id", "message")


def with_prescan_ids(findings: DataFrame, key: list[str], hot: bool = False) -> DataFrame:
    """findings with id P1, P2, ... in each unit of key: file checks before project checks, each by path and line.

    hot: ranks are counted over ranges, for units with more findings than one task should sort; equal findings must be taken out before."""
    order = ["path", "line", "class_id", "message", "blocking"]
    project = F.col("class_id").isin(PROJECT_CLASSES)
    if hot:
        rows = ranked(findings.withColumn("__project", project), key, ["__project", *order], "__id").drop("__project")
        return rows.withColumn("id", F.concat(F.lit("P"), F.col("__id").cast("string"))).drop("__id")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(project, *order))
    return findings.withColumn("id", F.concat(F.lit("P"), number.cast("string")))


def capped(rows: DataFrame, key: list[str], order: list[Column | str], limit: int, sentinel: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first `limit` rows of each unit and, for a unit with as many, the row that sentinel makes of its key."""
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= limit).drop("held")
    return numbered.filter(F.col("rn") <= limit).drop("rn").unionByName(sentinel(full))


def failing_units(findings: DataFrame, key: list[str]) -> DataFrame:
    """key, failing: whether a finding of the unit blocks."""
    return findings.groupBy(*key).agg(F.bool_or("blocking").alias("failing"))


def as_json(findings: DataFrame) -> Column:
    """The JSON object of a finding that has an id."""
    return F.to_json(
        F.struct("id", F.col("path").alias("file"), "line", F.col("class_id").alias("class"), "message", "blocking")
    )


def as_text() -> Column:
    level = F.when(F.col("blocking"), "error").otherwise("warning")
    return F.format_string("%s:%d: %s %s: %s", "path", "line", "class_id", level, "message")


def write_findings(findings: DataFrame, path: str, form: str = "json", units: list[str] | None = None, scanned: DataFrame | None = None) -> None:
    """Writes findings in folders by unit and class: as JSON lines, Parquet, or lines of text.

    What the folder holds of other units stays. A unit of `scanned` (the units of findings, if there is none) is replaced: classes that it has no finding
    of any more go. One run writes the folder at a time; a run that was cut short is made good by running it again."""
    units = units or []
    by = [*units, "class"]
    rows = findings.withColumn("class", F.col("class_id"))
    rows = rows.select(*by, as_text().alias("value")) if form == "text" else rows
    if units:
        spark = findings.sparkSession
        anew = (findings if scanned is None else scanned).select(*units).distinct()
        for folder in _stale(spark, path, by, anew, rows.select(*by).distinct()):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    mode = "dynamic" if units else "static"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).format(form).save(path)


def _stale(spark: SparkSession, path: str, by: list[str], anew: DataFrame, new: DataFrame) -> list:
    """Folders under path of units that are written anew and classes that they no longer have; folders are told by their names, no file is read."""
    jvm, root = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "/".join(f"{c}=*" for c in by))) if files.exists(root) else []
    folders = [status.getPath() for status in found or []]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName

    def values(folder) -> tuple[str, ...]:
        parts = []
        for _ in by:
            parts.append(unescape(folder.getName().split("=", 1)[1]))
            folder = folder.getParent()
        return tuple(reversed(parts))

    if not folders:
        return []
    named = spark.createDataFrame([(i, *values(f)) for i, f in enumerate(folders)], "at int, " + ", ".join(f"`{c}` string" for c in by))
    as_names = lambda rows, names: rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in names])
    gone = named.join(as_names(anew, by[:-1]), by[:-1], "left_semi").join(as_names(new, by), by, "left_anti")
    return [folders[r.at] for r in gone.select("at").collect()]
