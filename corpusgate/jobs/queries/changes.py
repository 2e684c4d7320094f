"""Queries of change sets: patches, added lines, packing, envelopes; line items taken as changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.jobs.queries.scans import IN, SUFFIX, TEST
from corpusgate.functions.text import SOURCE
from corpusgate.operators import dependencies, diffs, findings, packing
from corpusgate.operators.ranges import dealt, pack_ranges, written
from corpusgate.sources.synth import VIEWS, table, view, with_views

PR = ["pr"]
BUDGET = 260
MOST = 2
#: A finding on a line near the top of each changed file, and a project finding for some.
VIEWS["pr_findings"] = """
SELECT pr, path, CAST(1 + (length(patch) + ord * 7) % 60 AS INT) AS line, CASE WHEN ord % 3 = 0 THEN 'D2' ELSE 'M12' END AS class_id,
  'found ' || path AS message, ord % 2 = 0 AS blocking FROM ({changes}) AS c"""
#: The same over changes that are at hand.
FOUND = VIEWS["pr_findings"].replace("({changes})", "{c}")
VIEWS["pr_findings"] = VIEWS["pr_findings"].replace("({changes})", "(" + VIEWS["changes"] + ")")
EXCLUDE = ["web/*1.ts", "tests/test_p?[0-4].py"]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, whose line items are dealt before it makes patches of them: they are narrower so."""
    return spark.sql(VIEWS["changes"], lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches of each change set put together and taken apart again."""
    rows = _changes(spark, sf_dir).filter("patch <> ''")
    whole = rows.withColumn("piece", F.concat(F.lit("diff --git a b\n"), F.regexp_replace("patch", "\n*$", "\n")))
    diff = whole.groupBy(*PR).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("diff"))
    parts = diffs.split_patches(diff, PR)
    return parts.select("pr", "ord", F.md5("patch").alias("digest"))


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs.added_lines(_changes(spark, sf_dir), ["pr", "ord"])
    return rows.groupBy("pr", "ord").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum("line").alias("total"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    found = spark.sql(FOUND, c=changes)
    return diffs.keep_on_added(found, changes, diffs.added_ranges(changes, PR), PR, EXCLUDE)


def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("pr", "ord", "path", diffs.match_globs(F.col("path"), EXCLUDE).alias("excluded"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed_of(_changes(spark, sf_dir))


def _packed_of(changes: DataFrame) -> DataFrame:
    changes = changes.filter("not is_binary and decodable and patch <> ''")
    return packing.limit_chunks(packing.pack_chunks(packing.measured(changes), PR, BUDGET), MOST)


def packed_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as the files of one change set, and each order's as those of another: packed over ranges.

    first and last are int, as the SQL has them, where the places in the large set are; the SQL has no rows for others, and here they are bigint."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("cost"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "cost"))
    # The numbered rows are written, as packing reads its sizes three times: to find ranges, to deal files to them and for files above the budget.
    lines = written(lines.select("l_orderkey", at.alias("at"), "cost"), "pack-lines")
    place = F.col("l_orderkey") * 100 + F.col("at")
    fit = lines.agg(F.bool_and(place.between(-(2**31), 2**31 - 1))).first()[0]
    of = lambda pr, order: F.struct(pr.cast("bigint").alias("pr"), order.cast("bigint" if fit is False else "int").alias("ord"))
    sets = F.array(of(F.lit(-1), place), of(F.col("l_orderkey"), F.col("at")))
    files = lines.select(F.explode(sets).alias("f"), "cost").select("f.pr", "f.ord", F.lit("x").alias("path"), "cost")
    return pack_ranges(files, PR, 120).groupBy("pr", "chunk").agg(
        F.count(F.lit(1)).alias("files"), F.sum("cost").alias("bytes"), F.min("ord").alias("first"), F.max("ord").alias("last")
    )


def unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unreviewed_files(_changes(spark, sf_dir), _packed(spark, sf_dir), PR)


def _prs(changes: DataFrame) -> DataFrame:
    by = changes.groupBy(*PR).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    metadata = F.struct(
        F.col("pr").alias("pr_number"), F.lit("0" * 40).alias("base_sha"), F.lit("1" * 40).alias("head_sha"), F.lit("").alias("chunk"), F.col("paths").alias("changed_files"), F.array().cast("array<string>").alias("unreviewed")
    )
    return by.select(*PR, "paths", metadata.alias("metadata"), F.concat(F.lit("Title: order "), F.col("pr").cast("string"), F.lit("\n\n")).alias("context"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of all change sets. The view's rows are numbered and dealt once, for patches, sizes, findings and lists of paths."""
    changes = dealt(_changes(spark, sf_dir), PR, "changes")
    found = spark.sql(FOUND, c=changes)
    prescan = findings.with_prescan_ids(findings.dedupe(found), PR)
    return packing.build_envelopes(changes, _packed_of(changes), prescan, _prs(changes), PR)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir)
    return rows.select("pr", "chunk", "chunks", F.array_join("files", ",").alias("files"), "prescan_items", "error")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each envelope, as its digest, and the two digests in it."""
    rows = _built(spark, sf_dir)
    return rows.select("pr", "chunk", F.sha2("envelope", 256).alias("envelope_sha256"), "trusted_hash", "target_hash", F.col("bytes").cast("bigint").alias("bytes"))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that an envelope leaves for patches, without a prescan."""
    none = F.array().cast("array<struct<id:string,file:string,line:int,class:string,message:string,blocking:boolean>>")
    rows = packing.chunk_budget(_prs(_changes(spark, sf_dir)).withColumn("prescan", none))
    return rows.select("pr", F.col("budget").cast("bigint").alias("budget"), "error")


def untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dependencies.untested_changes(_changes(spark, sf_dir).filter("pr % 3 <> 0 or path not like 'tests/%'"), PR)
    return rows


_EXCLUDED = "regexp_matches(path, '^(web/.*1\\.ts|tests/test_p.[0-4]\\.py)$')"
#: The lines that a patch adds, from how the view makes patches: three kinds of lines at known places.
_ADDED = """
(SELECT pr, ord, path, CAST(s + 1 + i AS INT) AS line FROM (SELECT *, CAST(regexp_extract(patch, '\\+([0-9]+),4 @@', 1) AS INT) AS s,
    len(regexp_extract_all(patch, '\\+added')) AS k FROM changes WHERE patch <> '') AS c, unnest(range(k)) AS r(i)
 UNION ALL SELECT pr, ord, path, CAST(CAST(regexp_extract(patch, '\\+([0-9]+),4 @@', 1) AS INT) + 2 + len(regexp_extract_all(patch, '\\+added')) AS INT) FROM changes WHERE patch <> ''
 UNION ALL SELECT pr, ord, path, CAST(regexp_extract(patch, '-90 \\+([0-9]+) @@', 1) AS INT) FROM changes WHERE contains(patch, '+late'))"""
_PACK = f"""
sized AS (SELECT pr, ord, path, CAST(strlen(CAST(to_json(patch) AS VARCHAR)) - 2 AS INT) AS cost FROM changes WHERE NOT is_binary AND decodable AND patch <> ''),
fits AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY ord) AS rn FROM sized WHERE cost <= {BUDGET}),
walk AS (SELECT pr, ord, path, cost, rn, 1 AS chunk, cost AS size FROM fits WHERE rn = 1
  UNION ALL SELECT f.pr, f.ord, f.path, f.cost, f.rn, CASE WHEN w.size + f.cost > {BUDGET} THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN w.size + f.cost > {BUDGET} THEN f.cost ELSE w.size + f.cost END FROM walk AS w JOIN fits AS f ON f.pr = w.pr AND f.rn = w.rn + 1),
packed AS (SELECT pr, ord, path, cost, CAST(chunk AS INT) AS chunk, false AS oversized, chunk > {MOST} AS overflow FROM walk
  UNION ALL SELECT pr, ord, path, cost, CAST(NULL AS INT), true, false FROM sized WHERE cost > {BUDGET})
"""


def _with_packed(sql: str, *names: str) -> str:
    return with_views(sql, "changes", *names).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n" + sql, ", " + _PACK + sql)


_KEPT = f"""
SELECT DISTINCT f.* FROM pr_findings AS f JOIN (SELECT DISTINCT pr, path FROM changes) AS c USING (pr, path)
WHERE NOT {_EXCLUDED.replace('path', 'f.path')} AND (class_id = 'D2' OR EXISTS (SELECT 1 FROM {_ADDED} AS a WHERE a.pr = f.pr AND a.path = f.path AND a.line = f.line))"""
_ZEROS = "'" + "0" * 64 + "'"
_BUDGET = f"""
SELECT pr, CAST({packing.MAX_BYTES} - strlen('{{"schema_version":"1","mode":"PR","TRUSTED_CONTEXT":{{"note":"{packing.TRUSTED_NOTE}","metadata":{{"pr_number":' || pr || ',"base_sha":"' || repeat('0', 40)
  || '","head_sha":"' || repeat('1', 40) || '","chunk":"","changed_files":["' || string_agg(path, '","') || '"],"unreviewed":[]}},"prescan":[],"sha256":"' || {_ZEROS}
  || '"}},"REVIEW_TARGET":{{"note":"{packing.TARGET_NOTE}","context":"Title: order ' || pr || '____","files":{{"' || string_agg(path, '":"","') || '":""}},"sha256":"' || {_ZEROS} || '"}}}}') AS BIGINT) AS budget,
  CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT pr, path FROM changes) GROUP BY pr"""
#: Envelopes and what their digests are of, from aggregated parts: plain with "," and ":", and in canonical form.
_ENVELOPES = f"""
, kept AS (SELECT pr, ord, path, chunk, max(chunk) OVER (PARTITION BY pr) AS chunks FROM packed WHERE NOT oversized AND NOT overflow),
last AS (SELECT k.pr, k.ord, k.path, k.chunk, k.chunks, CAST(to_json(patch) AS VARCHAR) AS patch FROM kept AS k JOIN changes AS c ON c.pr = k.pr AND c.ord = k.ord
  QUALIFY row_number() OVER (PARTITION BY k.pr, k.chunk, k.path ORDER BY k.ord DESC) = 1),
files AS (SELECT pr, chunk, chunks, string_agg('"' || path || '":' || patch, ',' ORDER BY ord) AS plain, string_agg('"' || path || '": ' || patch, ', ' ORDER BY path) AS canon FROM last GROUP BY ALL),
ids AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY class_id = 'D2', path, line, class_id, message, blocking) AS n FROM (SELECT DISTINCT * FROM pr_findings)),
items AS (SELECT k.pr, k.chunk,
  string_agg('{{"id":"P' || n || '","file":"' || i.path || '","line":' || line || ',"class":"' || class_id || '","message":"' || message || '","blocking":' || blocking || '}}', ',' ORDER BY n) AS plain,
  string_agg('{{"blocking": ' || blocking || ', "class": "' || class_id || '", "file": "' || i.path || '", "id": "P' || n || '", "line": ' || line || ', "message": "' || message || '"}}', ', ' ORDER BY n) AS canon
  FROM ids AS i JOIN kept AS k ON k.pr = i.pr AND k.path = i.path GROUP BY k.pr, k.chunk),
paths AS (SELECT pr, string_agg('"' || path || '"', ',' ORDER BY path) AS plain, string_agg('"' || path || '"', ', ' ORDER BY path) AS canon FROM (SELECT DISTINCT pr, path FROM changes) GROUP BY pr),
hashed AS (SELECT f.pr, f.chunk, f.chunks, f.plain AS files, coalesce(i.plain, '') AS items, p.plain AS paths,
  sha256('{{"metadata": {{"base_sha": "' || repeat('0', 40) || '", "changed_files": [' || p.canon || '], "chunk": "' || f.chunk || '/' || f.chunks || '", "head_sha": "' || repeat('1', 40) || '", "pr_number": ' || f.pr
    || ', "unreviewed": []}}, "prescan": [' || coalesce(i.canon, '') || ']}}') AS trusted_hash,
  sha256('{{"context": "Title: order ' || f.pr || '\\n\\n", "files": {{' || f.canon || '}}}}') AS target_hash
  FROM files AS f LEFT JOIN items AS i ON i.pr = f.pr AND i.chunk = f.chunk JOIN paths AS p ON p.pr = f.pr)
SELECT pr, chunk, sha256(envelope) AS envelope_sha256, trusted_hash, target_hash, CAST(strlen(envelope) AS BIGINT) AS bytes FROM (SELECT *,
  '{{"schema_version":"1","mode":"PR","TRUSTED_CONTEXT":{{"note":"{packing.TRUSTED_NOTE}","metadata":{{"pr_number":' || pr || ',"base_sha":"' || repeat('0', 40) || '","head_sha":"' || repeat('1', 40)
  || '","chunk":"' || chunk || '/' || chunks || '","changed_files":[' || paths || '],"unreviewed":[]}},"prescan":[' || items || '],"sha256":"' || trusted_hash || '"}},"REVIEW_TARGET":{{"note":"{packing.TARGET_NOTE}","context":"Title: order '
  || pr || '\\n\\n","files":{{' || files || '}},"sha256":"' || target_hash || '"}}}}' AS envelope FROM hashed)"""
_SOURCE = f"({SUFFIX} IN {IN(SOURCE)} AND NOT {TEST})"
QUERIES = {
    "p1_split_patches": (
        patches,
        with_views(
            "SELECT pr, CAST(row_number() OVER (PARTITION BY pr ORDER BY ord) AS INT) AS ord, md5('diff --git a b' || chr(10) || rtrim(patch, chr(10)) || chr(10)) AS digest FROM changes WHERE patch <> ''",
            "changes",
        ),
    ),
    "p2_added_lines": (
        added,
        with_views(
            f"SELECT pr, ord, count(*) AS lines, min(line) AS first, max(line) AS last, CAST(sum(line) AS BIGINT) AS total FROM {_ADDED} GROUP BY pr, ord", "changes"
        ),
    ),
    "p3_keep_on_added": (lambda spark, sf_dir: kept(spark, sf_dir).distinct(), with_views(_KEPT, "changes", "pr_findings")),
    "p4_match_globs": (globs, with_views(f"SELECT pr, ord, path, {_EXCLUDED} AS excluded FROM changes", "changes")),
    "p5_dedupe_sort": (
        lambda spark, sf_dir: findings.ordered(findings.dedupe(view(spark, sf_dir, "pr_findings")), PR),
        with_views("SELECT DISTINCT * FROM pr_findings", "pr_findings"),
    ),
    "p8_p9_pack_chunks": (_packed, _with_packed("SELECT * FROM packed")),
    "p8_pack_ranges": (
        packed_by_ranges,
        """WITH RECURSIVE each AS (SELECT l_orderkey AS pr, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT)) AS INT) AS ord, CAST(l_quantity AS INT) AS cost FROM lineitem),
        files AS (SELECT pr, ord, cost FROM each UNION ALL SELECT -1, CAST(pr * 100 + ord AS INT), cost FROM each),
        sums AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY ord) AS rn, sum(cost) OVER (PARTITION BY pr ORDER BY ord) AS upto FROM files),
        links AS MATERIALIZED (SELECT s.pr, s.rn, CAST(min(t.rn) AS BIGINT) AS nxt FROM (SELECT pr, rn, upto - cost + 120 AS most FROM sums) AS s
          ASOF JOIN (SELECT pr, rn, upto FROM sums) AS t ON s.pr = t.pr AND t.upto > s.most GROUP BY s.pr, s.rn),
        walk AS (SELECT pr, CAST(1 AS BIGINT) AS rn, 1 AS chunk FROM sums WHERE rn = 1 UNION ALL SELECT w.pr, l.nxt, w.chunk + 1 FROM walk AS w JOIN links AS l ON l.pr = w.pr AND l.rn = w.rn)
        SELECT s.pr, CAST(chunk AS INT) AS chunk, count(*) AS files, CAST(sum(cost) AS BIGINT) AS bytes, min(ord) AS first, max(ord) AS last
        FROM sums AS s ASOF JOIN walk AS w ON s.pr = w.pr AND s.rn >= w.rn GROUP BY s.pr, chunk""",
    ),
    "p10_chunk_budget": (budgets, with_views(_BUDGET, "changes")),
    "p11_unreviewed_files": (
        unreviewed,
        _with_packed(
            "SELECT pr, path, 'binary' AS reason FROM changes WHERE is_binary UNION ALL SELECT pr, path, 'undecodable' FROM changes WHERE NOT decodable "
            "UNION ALL SELECT pr, path, 'empty' FROM changes WHERE NOT is_binary AND decodable AND patch = '' "
            "UNION ALL SELECT pr, path, 'oversized' FROM packed WHERE oversized UNION ALL SELECT pr, path, 'overflow' FROM packed WHERE overflow"
        ),
    ),
    "p12_p13_envelopes": (
        envelopes,
        _with_packed(
            """
SELECT pr, chunk, chunks, files, CAST(coalesce(n, 0) AS INT) AS prescan_items, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT pr, chunk, string_agg(path, ',' ORDER BY ord) AS files, max(max(chunk)) OVER (PARTITION BY pr) AS chunks FROM packed WHERE NOT oversized AND NOT overflow GROUP BY pr, chunk) AS e
LEFT JOIN (SELECT pr, chunk, count(*) AS n FROM (SELECT DISTINCT * FROM pr_findings) AS f JOIN packed AS p USING (pr, path) WHERE NOT oversized AND NOT overflow GROUP BY pr, chunk) AS x USING (pr, chunk)""",
            "pr_findings",
        ),
    ),
    "p12_envelope_digests": (digests, _with_packed(_ENVELOPES, "pr_findings").replace(", " + _PACK + _ENVELOPES, ", " + _PACK.rstrip() + _ENVELOPES)),
    "d3_untested_changes": (
        untested,
        with_views(
            f"""
SELECT pr, first AS path, 1 AS line, 'C3' AS class_id, CAST(n AS VARCHAR) || ' source file(s) changed without a test change' AS message, false AS blocking FROM (
  SELECT pr, count(*) FILTER ({_SOURCE}) AS n, bool_or({TEST}) AS tested, arg_min(path, ord) FILTER ({_SOURCE}) AS first FROM changes
  WHERE pr % 3 <> 0 OR path NOT LIKE 'tests/%' GROUP BY pr) WHERE NOT tested AND n > 0""",
            "changes",
        ),
    ),
}
