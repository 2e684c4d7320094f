"""Queries of line scans, paths and text functions, over documents taken as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions import text as T
from corpusgate.operators import dependencies, findings, prose, textscan
from corpusgate.operators.content import scan_distinct_blobs
from corpusgate.sources.synth import table, view, with_views

ENDS = "'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'"


def sql_lines(source: str = "doc_files", text: str = "text", keep: str = "repo, rev, path") -> str:
    """A subquery of lines: keep, line, t."""
    parts = f"string_split_regex({text}, {ENDS})"
    whole = f"CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END"
    return f"(SELECT {keep}, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line, unnest(l) AS t FROM (SELECT *, {whole} AS l FROM {source}))"


SUFFIX = "regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1)"
IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
TEST = (
    "(list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['tests', 'test', '__tests__', 'spec']) "
    "OR list_extract(string_split(path, '/'), -1) LIKE 'test\\_%' ESCAPE '\\' OR string_split(list_extract(string_split(path, '/'), -1), '.')[1] LIKE '%\\_test' ESCAPE '\\' "
    "OR contains(list_extract(string_split(path, '/'), -1), '.spec.') OR contains(list_extract(string_split(path, '/'), -1), '.test.'))"
)


def _finding(class_id: str, message: str, blocking: bool, where: str, kinds: list[str] | None) -> str:
    """SQL for one finding a line."""
    only = f"{SUFFIX} IN {IN(kinds)} AND " if kinds else ""
    return (
        f"SELECT repo, rev, path, line, '{class_id}' AS class_id, {message} AS message, {str(blocking).lower()} AS blocking "
        f"FROM {sql_lines()} WHERE {only}{where}"
    )


HOST_OK = "regexp_matches(lower(h), '(^|\\.)(example\\.(com|org|net)|localhost)$|\\.(example|test|invalid)$')"
URLS = "regexp_extract_all(t, 'https?://([A-Za-z0-9.-]+)', 1)"
IPV4 = "regexp_matches(t, '(^|[^0-9.])([0-9]{1,3}\\.){3}[0-9]{1,3}([^0-9.]|$)')"
SUPPRESSED = "(" + " OR ".join(f"contains(t, '{s}')" for s in textscan.SUPPRESSIONS) + ")"
FAILS = "(contains(path, '.github/workflows/') AND regexp_matches(t, '^\\s*continue-on-error:\\s*true\\b'))"
USES = "regexp_extract(t, '^\\s*-?\\s*uses:\\s*[''\"]?([^''\"\\s#]+)', 1)"
PINNED = f"CASE WHEN starts_with({USES}, 'docker://') THEN contains({USES}, '@sha256:') ELSE regexp_matches({USES}, '@[0-9a-f]{{40}}$') END"
SQL_MARKERS = _finding("M12", "'deferred-work marker'", True, "regexp_matches(t, '\\b(?:TODO|FIXME|XXX|HACK)\\b')", T.SOURCE + T.CONFIG)
SQL_SUPPRESSED = _finding(
    "M13", f"CASE WHEN {SUPPRESSED} THEN 'check suppression' ELSE 'CI step allowed to fail' END", True, f"({SUPPRESSED} OR {FAILS})", T.SOURCE + T.CONFIG
)
DEBUGGER = "regexp_matches(t, '^\\s*debugger\\s*;?\\s*$')"
SQL_DEBUG = _finding(
    "M17", f"CASE WHEN {DEBUGGER} THEN 'debugger statement' ELSE 'console.log call left in code' END", False,
    f"({DEBUGGER} OR regexp_matches(t, '\\bconsole\\.log\\s*\\('))", T.JS,
)
REAL_URL = f"len(list_filter({URLS}, lambda h: NOT {HOST_OK})) > 0"
LONE_IP = f"({IPV4} AND len({URLS}) = 0)"
HOME = "regexp_matches(t, '[\"''](/home/|/Users/|[A-Za-z]:\\\\)')"
SQL_ENV = _finding(
    "M18", f"CASE WHEN {REAL_URL} THEN 'hardcoded URL' WHEN {LONE_IP} THEN 'hardcoded IPv4 address' ELSE 'hardcoded absolute user path' END", False,
    f"NOT {TEST} AND ({REAL_URL} OR {LONE_IP} OR {HOME})", T.SOURCE,
)
SQL_PINS = _finding(
    "D1", f"'''' || {USES} || ''' is not pinned to a full SHA'", False,
    f"contains('/' || path, '.github/') AND {USES} <> '' AND NOT starts_with({USES}, './') AND NOT ({PINNED})", [".yml", ".yaml"],
)
LINE_CHECKS = [textscan.incomplete_markers, textscan.suppressions, textscan.js_debug, textscan.hardcoded_env, textscan.unpinned_actions]
SQL_LINE_CHECKS = " UNION ".join([SQL_MARKERS, SQL_SUPPRESSED, SQL_DEBUG, SQL_ENV, SQL_PINS])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "doc_files")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def all_line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return findings.dedupe(findings.union([check(files) for check in LINE_CHECKS]))


def _on_files(scan):
    return lambda spark, sf_dir: scan(_files(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.explode_lines(_files(spark, sf_dir), ["doc_id"])
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line_text")).alias("chars"), F.max("line").cast("bigint").alias("last_line")
    )


def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.path_facts(_files(spark, sf_dir).select("doc_id", "path"))


def distinct_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of license lines, each distinct text being read once."""
    docs = _documents(spark, sf_dir).select(
        F.col("source").alias("repo"), F.lit("head").alias("rev"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("blob_id"), "text"
    )
    counted = lambda rows: rows.select("blob_id", "dispatch", F.regexp_count("text", F.lit("[Ll]icen[cs]e")).cast("bigint").alias("hits"))
    return scan_distinct_blobs(docs, F.lit("text"), counted).select("repo", "path", "blob_id", "hits")


def prescan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_prescan_ids(all_line_findings(spark, sf_dir), ["repo", "rev"])


def prescan_ids_of_hot_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids, counted over ranges."""
    return findings.with_prescan_ids(findings.dedupe(all_line_findings(spark, sf_dir)), ["repo", "rev"], hot=True)


LIMIT = 5


def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most LIMIT findings of each repository, and a row that says so where there were as many."""
    rows = all_line_findings(spark, sf_dir).select("repo", "path", "line", "message")

    def sentinel(units: DataFrame) -> DataFrame:
        return units.select("repo", F.lit("").alias("path"), F.lit(0).alias("line"), F.lit("limit reached").alias("message"))

    return findings.capped(rows, ["repo"], ["path", "line", "message"], LIMIT, sentinel)


def blocking_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.failing_units(all_line_findings(spark, sf_dir), ["repo"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and credential lines by source and language, with labels: a verdict for each source."""
    files = _files(spark, sf_dir)
    found = all_line_findings(spark, sf_dir).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("found"), F.bool_or("blocking").alias("blocking"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hidden = (T.redact_credentials(F.col("text")) != F.col("text")).cast("bigint")
    rows = files.select("doc_id", "repo", "path", hidden.alias("credentials")).join(found, ["repo", "path"], "left").join(labels, "doc_id", "left")
    return rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("findings"),
        F.sum("credentials").alias("credential_files"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic_files"),
        F.coalesce(F.bool_or("blocking"), F.lit(False)).alias("failing"),
    )


CREDENTIAL = "'(?i)(token|password|secret|authorization)(\\s*[:=]\\s*)\\S+'"
SQL_FLAGSHIP = f"""
SELECT repo, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, CAST(sum(c) AS BIGINT) AS credential_files,
  CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic_files, coalesce(bool_or(b), false) AS failing
FROM (SELECT doc_id, repo, path, CAST(regexp_matches(text, {CREDENTIAL}) AS BIGINT) AS c FROM doc_files) AS f
LEFT JOIN (SELECT repo, path, count(*) AS n, bool_or(blocking) AS b FROM ({SQL_LINE_CHECKS}) GROUP BY ALL) AS x USING (repo, path)
LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) AS l USING (doc_id) GROUP BY repo"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts with credentials taken out, and with control characters replaced as well."""
    text = F.col("text")
    return _files(spark, sf_dir).select(
        "doc_id",
        F.md5(T.redact_credentials(text)).alias("redacted"),
        F.md5(T.clean_control(text)).alias("cleaned"),
        T.has_literal_escape(text).alias("literal_escape"),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the last occurrence of " the " in each text that has one."""
    start = F.char_length(F.element_at(F.split("text", " the ", -1), -1))
    place = prose.locate(F.col("text"), F.char_length("text") - start - 5).alias("at")
    rows = _documents(spark, sf_dir).filter(F.contains(F.col("text"), F.lit(" the "))).select("doc_id", place)
    return rows.select("doc_id", F.col("at.line").alias("line"), F.col("at.column").alias("column"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.escaped_size(F.col("text")).cast("bigint").alias("bytes"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "hosts").select("page_id", "host", T.is_documentation_host(F.col("host")).alias("documentation"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of English texts, as its SQL has it; w2_prose_category_counts_all reads every text."""
    return prose.prose_category_counts(_documents(spark, sf_dir).filter("lang = 'en'"), ["source"])


def all_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.prose_category_counts(_documents(spark, sf_dir), ["source"])


def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import names of distributions called after parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    package = F.when(F.col("p_partkey") % 5 == 0, "PyYAML").when(F.col("p_partkey") % 5 == 1, "scikit_learn").otherwise(F.replace("p_name", F.lit(" "), F.lit("._-")))
    return parts.select("p_partkey", dependencies.import_name(package).alias("import_name"))


_PLAIN = "lower(regexp_replace(p, '[-_.]+', '-', 'g'))"
SQL_IMPORT_NAMES = f"""
SELECT p_partkey, CASE {_PLAIN} WHEN 'pyyaml' THEN 'yaml' WHEN 'scikit-learn' THEN 'sklearn' ELSE replace({_PLAIN}, '-', '_') END AS import_name
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'PyYAML' WHEN p_partkey % 5 = 1 THEN 'scikit_learn' ELSE replace(p_name, ' ', '._-') END AS p FROM part)"""
_COUNTS = ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}" for n, p in prose.COUNTED.items())
_NUMBERED = (
    f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line, message) AS rn, count(*) OVER (PARTITION BY repo) AS held FROM ({SQL_LINE_CHECKS})"
)
QUERIES = {
    "flagship_source_gate": (flagship, with_views(SQL_FLAGSHIP, "doc_files")),
    "s4_lines": (
        lines,
        with_views(
            f"SELECT doc_id, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(max(line) AS BIGINT) AS last_line FROM {sql_lines(keep='doc_id')} GROUP BY doc_id",
            "doc_files",
        ),
    ),
    "s5_path_facts": (
        path_facts,
        with_views(
            f"SELECT doc_id, path, {SUFFIX} AS suffix, {TEST} AS is_test, {SUFFIX} IN {IN(T.SOURCE)} AS is_source, {SUFFIX} IN {IN(T.CONFIG)} AS is_config, "
            f"{SUFFIX} IN {IN(T.JS)} AS is_js, lower({SUFFIX}) IN {IN(T.MARKDOWN)} AS is_markdown FROM doc_files",
            "doc_files",
        ),
    ),
    "s6_distinct_blobs": (
        distinct_blobs,
        "SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, md5(text) AS blob_id, CAST(len(regexp_extract_all(text, '[Ll]icen[cs]e')) AS BIGINT) AS hits FROM documents",
    ),
    "t1_incomplete_markers": (_on_files(textscan.incomplete_markers), with_views(SQL_MARKERS, "doc_files")),
    "t2_suppressions": (_on_files(textscan.suppressions), with_views(SQL_SUPPRESSED, "doc_files")),
    "t4_js_debug": (_on_files(textscan.js_debug), with_views(SQL_DEBUG, "doc_files")),
    "t5_hardcoded_env": (_on_files(textscan.hardcoded_env), with_views(SQL_ENV, "doc_files")),
    "t6_documentation_host": (hosts, with_views(f"SELECT page_id, h AS host, {HOST_OK} AS documentation FROM (SELECT page_id, host AS h FROM hosts)", "hosts")),
    "t14_action_pins": (_on_files(textscan.unpinned_actions), with_views(SQL_PINS, "doc_files")),
    "u11_run_line_checks": (all_line_findings, with_views(SQL_LINE_CHECKS, "doc_files")),
    "p6_prescan_ids": (
        prescan_ids,
        with_views(
            f"SELECT *, 'P' || CAST(row_number() OVER (PARTITION BY repo, rev ORDER BY path, line, class_id, message) AS VARCHAR) AS id FROM ({SQL_LINE_CHECKS})",
            "doc_files",
        ),
    ),
    "p6_prescan_ids_of_hot_units": (
        prescan_ids_of_hot_units,
        with_views(
            f"SELECT *, 'P' || CAST(row_number() OVER (PARTITION BY repo, rev ORDER BY path, line, class_id, message) AS VARCHAR) AS id FROM ({SQL_LINE_CHECKS})",
            "doc_files",
        ),
    ),
    "u9_cap_with_sentinel": (
        cap,
        with_views(
            f"SELECT repo, path, line, message FROM ({_NUMBERED}) WHERE rn <= {LIMIT} UNION ALL "
            f"SELECT DISTINCT repo, '' AS path, 0 AS line, 'limit reached' AS message FROM ({_NUMBERED}) WHERE held >= {LIMIT}",
            "doc_files",
        ),
    ),
    "u10_blocking_status": (blocking_status, with_views(f"SELECT repo, bool_or(blocking) AS failing FROM ({SQL_LINE_CHECKS}) GROUP BY repo", "doc_files")),
    "p7_escaped_size": (escaped, "SELECT doc_id, CAST(strlen(CAST(to_json(text) AS VARCHAR)) - 2 AS BIGINT) AS bytes FROM documents"),
    "d6_import_name": (import_names, SQL_IMPORT_NAMES),
    "w2_prose_category_counts": (category_counts, f"SELECT source, count(*) AS texts, {_COUNTS} FROM documents WHERE lang = 'en' GROUP BY source"),
    "w2_prose_category_counts_all": (all_category_counts, f"SELECT source, count(*) AS texts, {_COUNTS} FROM documents GROUP BY source"),
    "w4_locate": (
        located,
        """
SELECT doc_id, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line, CAST(length(list_extract(string_split(head, chr(10)), -1)) + 1 AS INT) AS column
FROM (SELECT doc_id, substr(text, 1, length(text) - length(list_extract(string_split(text, ' the '), -1)) - 5) AS head FROM documents WHERE contains(text, ' the '))""",
    ),
    "w6_w7_w9_cleaned": (
        cleaned,
        with_views(
            f"SELECT doc_id, md5(regexp_replace(text, {CREDENTIAL}, '\\1\\2<redacted>', 'g')) AS redacted, "
            f"md5(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '?', 'g'), {CREDENTIAL}, '\\1\\2<redacted>', 'g')) AS cleaned, "
            "contains(text, '\\n') AS literal_escape FROM doc_files",
            "doc_files",
        ),
    ),
}
