"""Repositories, changes, commits and reports made from the driver's tables by SQL that Spark and DuckDB both run.

Each view is one SELECT over {tables} in braces. Spark gets the tables as DataFrames, an oracle gets their names, so a
query and its oracle start from the same rows. Both engines take the functions used here alike: md5, chr, concat by ||,
CASE, lpad, repeat, and casts to STRING, BIGINT and INT.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpusgate.functions.spread import spread

NL = "chr(10)"
#: Lines that doc_files appends to documents, by doc_id modulo 12: each is a finding of a scan, or nearly one.
APPENDED = (
    "x = 1  # TODO later",
    "value()  # noqa",
    "console.log(value);",
    "debugger;",
    "u = https://api.service.io/v1",
    "u = https://docs.example.com/v1 and 10.1.2.3",
    "host 10.20.30.40 is up",
    "continue-on-error: true",
    "password: hunter2secret",
    "uses: actions/checkout@v4",
    "uses: docker://alpine@sha256:00ff",
    "nothing to see",
)


def _appended() -> str:
    cases = " ".join(f"WHEN {i} THEN '{line}'" for i, line in enumerate(APPENDED))
    return f"CASE doc_id % {len(APPENDED)} {cases} END"


VIEWS: dict[str, str] = {}
VIEWS["doc_files"] = f"""
SELECT doc_id, source AS repo, 'head' AS rev,
  CASE doc_id % 5 WHEN 0 THEN 'src/doc_' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN 'web/doc_' || CAST(doc_id AS STRING) || '.js'
    WHEN 2 THEN 'docs/doc_' || CAST(doc_id AS STRING) || '.md' WHEN 3 THEN '.github/workflows/doc_' || CAST(doc_id AS STRING) || '.yml'
    ELSE 'tests/doc_' || CAST(doc_id AS STRING) || '.go' END AS path,
  md5(text) AS blob_id, '100644' AS mode, text || {NL} || {_appended()} AS text
FROM {{documents}}"""
#: Patches: a header, one hunk with unchanged, removed and added lines, and a second hunk for some.
VIEWS["changes"] = f"""
SELECT pr, ord, path, patch, is_binary, decodable FROM (
  SELECT l_orderkey AS pr, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ord,
    CASE l_suppkey % 4 WHEN 0 THEN 'src/p' || CAST(l_partkey AS STRING) || '.py' WHEN 1 THEN 'tests/test_p' || CAST(l_partkey AS STRING) || '.py'
      WHEN 2 THEN 'web/p' || CAST(l_partkey AS STRING) || '.ts' ELSE 'eval/cases/c' || CAST(l_partkey AS STRING) || '/expected.json' END AS path,
    CASE WHEN l_partkey % 17 = 0 THEN '' ELSE
      '--- a/x' || {NL} || '+++ b/x' || {NL} || '@@ -1,3 +' || CAST(1 + l_partkey % 50 AS STRING) || ',4 @@' || {NL} || ' keep' || {NL}
      || repeat('+added ' || l_returnflag || {NL}, CAST(l_quantity AS INT) % 7) || '-gone' || {NL} || ' keep' || {NL} || '++plus' || {NL}
      || CASE WHEN l_linenumber % 2 = 0 THEN '@@ -90 +' || CAST(100 + l_suppkey AS STRING) || ' @@' || {NL} || '+late' || {NL} ELSE '' END
      || repeat('q', CAST(l_quantity AS INT)) END AS patch,
    l_partkey % 29 = 0 AS is_binary, l_partkey % 31 <> 0 AS decodable
  FROM {{lineitem}}) AS t"""
VIEWS["commits"] = f"""
SELECT 'repo' || CAST(c_nationkey AS STRING) AS repo, md5(CAST(o_orderkey AS STRING)) || substr(md5('x' || CAST(o_orderkey AS STRING)), 1, 8) AS sha,
  c_name AS author_name,
  CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS STRING) || '+user' || CAST(c_custkey AS STRING) || '@users.noreply.github.com'
    WHEN 1 THEN 'user' || CAST(c_custkey AS STRING) || '@users.noreply.github.com' WHEN 2 THEN 'u@corp.io' WHEN 3 THEN 'bot@mail.x.ai'
    WHEN 4 THEN CAST(c_custkey + 1 AS STRING) || '+user' || CAST(c_custkey AS STRING) || '@users.noreply.github.com' ELSE '' END AS author_email,
  CASE o_orderkey % 5 WHEN 0 THEN 'Grok Bot' ELSE c_name END AS committer_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'noreply@github.com' WHEN 1 THEN 'c@corp.io' ELSE '7+dev@users.noreply.github.com' END AS committer_email,
  'user' || CAST(c_custkey AS STRING) AS author_login, CASE o_orderkey % 4 WHEN 0 THEN 'ghost' ELSE 'user' || CAST(c_custkey AS STRING) END AS committer_login,
  CASE o_orderkey % 7 WHEN 0 THEN 'feat: add ' || o_orderpriority WHEN 1 THEN 'fix: a subject that is much longer than the limit of fifty characters'
    WHEN 2 THEN 'Update things' WHEN 3 THEN 'docs: end with a period.' WHEN 4 THEN 'chore: tidy (#' || CAST(o_orderkey AS STRING) || ')'
    WHEN 5 THEN 'ci: a subject of more than fifty characters, and a period too. (#12)' ELSE 'test:no space' END AS subject,
  CASE o_orderkey % 8 WHEN 0 THEN 'Why' || {NL} || {NL} || 'Co-authored-by: Helper Agent'
    WHEN 1 THEN 'Text' || {NL} || {NL} || 'Signed-off-by: A <a@b.io>' || {NL} || 'co-authored-by: Ann <ann@b.io>'
    WHEN 2 THEN 'Text' || {NL} || {NL} || 'Co-authored-by: Bob' || {NL} || ' <bob@b.io>' WHEN 3 THEN 'Key: value' || {NL} || 'not a trailer'
    WHEN 4 THEN 'Co-authored-by: xAI <dev@x.ai>' || {NL} || {NL} WHEN 5 THEN '' WHEN 6 THEN 'Text' || {NL} || {NL} || 'Co-Authored-By: <no@name.io>'
    ELSE 'It was written by hand' || {NL} || {NL} || 'Refs: 1' END AS body,
  o_orderkey AS seq, o_orderkey % 11 = 0 AS is_merge
FROM {{orders}} AS o JOIN {{customer}} AS c ON o.o_custkey = c.c_custkey"""
VIEWS["accounts"] = """
SELECT 'user' || CAST(c_custkey AS STRING) AS login, c_custkey AS id FROM {customer} WHERE c_custkey % 9 <> 0"""
VIEWS["branches"] = """
SELECT 'repo' || CAST(s_nationkey AS STRING) AS repo,
  CASE s_suppkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'feat/add-' || CAST(s_suppkey AS STRING) WHEN 2 THEN 'claude/x' WHEN 3 THEN 'fix/para-ti'
    WHEN 4 THEN 'docs/a1b2c3d' WHEN 5 THEN 'Fix/Upper' WHEN 6 THEN 'chore/use-sha256' WHEN 7 THEN 'test/damn-thing' ELSE 'feature-' || CAST(s_suppkey AS STRING) END AS branch
FROM {supplier}"""
#: The policy's classes: a fixed table, as far as tiers matter here.
CLASSES = (
    [(f"Q{n}", f"Quality {n}", ("Blocking", "Graded")[n % 2], n in (3, 5, 8, 9, 11, 13)) for n in range(1, 15)]
    + [(f"M{n}", f"Maintenance {n}", ("Graded", "Advisory", "Blocking")[n % 3], n in (1, 12, 13, 16, 17, 18)) for n in range(1, 19)]
    + [(f"C{n}", f"Change {n}", "Escalate", n == 3) for n in range(1, 4)]
    + [(f"D{n}", f"Dependency {n}", ("Graded", "Escalate")[n % 2], n in (1, 2, 5)) for n in range(1, 7)]
)
VIEWS["classes"] = "SELECT class_id, name, tier, has_script FROM (VALUES " + ", ".join(
    f"('{c}', '{n}', '{t}', {str(s).lower()})" for c, n, t, s in CLASSES
) + ") AS t(class_id, name, tier, has_script)"
#: A review of each order: findings of two classes, and defects by o_orderkey modulo 16.
VIEWS["reports"] = f"""
SELECT o_orderkey AS pr, 'PR' AS mode, class_1, severity_1, class_2,
  CASE k WHEN 1 THEN 'RISK: LOW' || {NL} ELSE '' END
  || CASE k WHEN 2 THEN 'Let me check this.' || {NL} WHEN 3 THEN '```' || {NL} || 'let me see' || {NL} || '```' || {NL} ELSE 'The change is small.' || {NL} END
  || CASE k WHEN 4 THEN '' ELSE 'VERDICT: ' || verdict || CASE k WHEN 5 THEN ' maybe' ELSE '' END || {NL} END
  || CASE k WHEN 6 THEN '' WHEN 7 THEN 'VERDICT_JSON: not json' WHEN 8 THEN 'VERDICT_JSON: [1]' ELSE
    'VERDICT_JSON: {{{{"schema_version":"' || CASE k WHEN 9 THEN '2' ELSE '1' END || '","verdict":"' || CASE k WHEN 10 THEN 'BLOCK' ELSE verdict END || '","findings":'
    || CASE k WHEN 11 THEN '7' ELSE '[{{{{"severity":"' || severity_1 || '","class":"' || class_1 || '","file":"' || CASE k WHEN 12 THEN 'other.py' ELSE 'a.py' END
      || '","line":' || CASE k WHEN 13 THEN '1.5' ELSE '3' END || ',"title":"t","confidence":"' || CASE k WHEN 14 THEN 'sure' ELSE 'likely' END
      || '"}}}},{{{{"severity":"LOW","class":"' || class_2 || '","file":"b.py","line":true,"title":"t","confidence":"certain"}}}}]' END
    || ',"prescan":[' || CASE k WHEN 15 THEN '' ELSE '{{{{"id":"P1","status":"confirmed","reason":"r"}}}}' END || ']}}}}' END AS text
FROM (SELECT o_orderkey, CAST(o_orderkey % 16 AS INT) AS k,
    CASE WHEN o_custkey % 5 = 0 THEN 'Q' || CAST(1 + o_custkey % 14 AS STRING) WHEN o_custkey % 5 = 1 THEN 'M' || CAST(1 + o_custkey % 18 AS STRING)
      WHEN o_custkey % 5 = 2 THEN 'C' || CAST(1 + o_custkey % 3 AS STRING) WHEN o_custkey % 5 = 3 THEN 'D' || CAST(1 + o_custkey % 6 AS STRING) ELSE 'Z9' END AS class_1,
    CASE o_custkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity_1,
    'M' || CAST(1 + o_orderkey % 18 AS STRING) AS class_2,
    CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'APPROVE' ELSE 'NEEDS-HUMAN' END AS verdict
  FROM {{orders}}) AS t""".replace("{{{{", "{{").replace("}}}}", "}}")
VIEWS["hosts"] = """
SELECT page_id, substr(rest, 1, CASE WHEN instr(rest, '/') > 0 THEN instr(rest, '/') - 1 ELSE length(rest) END) AS host
FROM (SELECT page_id, substr(url, instr(url, '//') + 2) AS rest FROM {pages}) AS t"""


def tables_of(sql: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; the texts that scans work on are spread over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "orders", "part", "lineitem") else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of a folder."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables_of(sql)})


def views(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(view(spark, sf_dir, n) for n in names)


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB: the views as common table expressions before the query."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in tables_of(VIEWS[n])})})" for n in names]
    return "WITH " + ", ".join(parts) + "\n" + sql
