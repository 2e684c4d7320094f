"""Queries of scans that parse files: samples with known findings, dealt to parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.operators import astscan, content, dependencies, filescan, findings, textscan
from corpusgate.sources import samples
from corpusgate.sources.synth import VIEWS, table, view, with_views

VIEWS |= {
    "python_files": samples.files_view(samples.PYTHON),
    "web_files": samples.files_view(samples.WEB),
    "tree_files": samples.files_view(samples.TREE),
    "manifest_files": samples.files_view(samples.MANIFESTS),
}
_FINDING = "line, class_id, message, blocking"
#: Trees with a manifest at their root and files that import: what is declared and imported is known by s_suppkey.
VIEWS["import_trees"] = """
SELECT 'repo' || CAST(s_suppkey AS STRING) AS repo, 'head' AS rev, path, text FROM {supplier} JOIN (VALUES
  (0, 'requirements.txt', 'numpy==1.0' || chr(10) || '# note' || chr(10) || 'PyYAML>=5' || chr(10) || '-r x' || chr(10) || 'unused-lib==2'),
  (1, 'pyproject.toml', '[project]' || chr(10) || 'dependencies = ["numpy>=1", "other"]'),
  (2, 'src/main.py', 'import numpy, os' || chr(10) || 'import yaml.nodes' || chr(10) || 'from requests import get' || chr(10) || 'from . import near'),
  (3, 'src/helper.py', 'import main' || chr(10) || 'import requests, pandas' || chr(10) || 'import pkg'),
  (4, 'pkg/__init__.py', ''),
  (5, 'package.json', '{{"dependencies": {{"react": "1", "left-pad": "2", "@types/node": "3"}}, "devDependencies": {{"@a/b": "1"}}}}'),
  (6, 'web/index.ts', 'import React from "react"' || chr(10) || 'import {{ x }} from "@a/b/c"' || chr(10) || 'const fs = require("fs")' || chr(10) || 'import "./local"' || chr(10) || 'import q from "query/x"')
) AS t(k, path, text) ON s_suppkey % 4 <> k % 4 OR k = 2 OR k = 6"""
VIEWS["manifest_paths"] = """
SELECT 'repo' || CAST(s_nationkey AS STRING) AS repo, 'head' AS rev, 'app' || CAST(s_suppkey AS STRING) || '/' || name AS path FROM {supplier} JOIN (VALUES
  (0, 'package.json'), (1, 'yarn.lock'), (2, 'pyproject.toml'), (3, 'Cargo.toml'), (4, 'Cargo.lock'), (5, 'go.mod'), (6, 'readme.md'))
  AS t(k, name) ON s_suppkey % 3 <> k % 3 OR k % 2 = 0"""
VIEWS["manifest_changes"] = """
SELECT 'repo' || CAST(s_nationkey AS STRING) AS repo, 'head' AS rev, 'app' || CAST(s_suppkey AS STRING) || '/' || name AS path FROM {supplier} JOIN (VALUES
  (0, 'package.json'), (1, 'yarn.lock'), (2, 'pyproject.toml'), (4, 'Cargo.lock'))
  AS t(k, name) ON s_suppkey % 5 <> k"""


def _on(name: str, scan, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scan(view(spark, sf_dir, name))
        return rows.select(*columns) if columns else rows

    return query


def _classes(*wanted: str):
    return lambda row: row[1] in wanted


TREE_COLUMNS = ("repo", "rev", "path", "check", "line", "message")


def _rules(check: str, scan):
    sql = samples.expected(samples.TREE, "check_name, line, message", lambda row: row[0] == check)
    return _on("tree_files", lambda files: scan(files).select(*TREE_COLUMNS).withColumnRenamed("check", "check_name")), sql


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astscan.python_imports(view(spark, sf_dir, "import_trees"))


def regex_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern in the samples, with its hazard."""
    files = view(spark, sf_dir, "python_files").unionByName(view(spark, sf_dir, "web_files"))
    return astscan.regex_hazards(astscan.regex_literals(files)).groupBy("pattern", "hazard").agg(F.count(F.lit(1)).alias("places"))


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filescan.compliance_scan(view(spark, sf_dir, "tree_files"), limit=None)
    return rows.select("repo", "rev", "path", F.col("check").alias("check_name"), "line", "message")


def lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.lockfile_drift(view(spark, sf_dir, "manifest_paths"), view(spark, sf_dir, "manifest_changes"))


def odd_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in several encodings, by doc_id, and decoded again: the texts' digests, and the inferred encodings."""
    docs = table(spark, sf_dir, "documents")
    way = F.col("doc_id") % 5
    text = F.col("text")
    bom = F.unhex(F.lit("EFBBBF"))
    written = (
        F.when(way == 1, F.concat(bom, F.encode(text, "UTF-8")))
        .when(way == 2, F.encode(text, "UTF-16LE"))
        .when(way == 3, F.encode(text, "UTF-16"))
        .when(way == 4, F.encode(text, "UTF-32"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    rows = docs.select("doc_id", written.alias("content"))
    read = content.decode_text(rows.withColumn("inferred", content.infer_bomless_utf("content")), "tree")
    return read.select("doc_id", F.md5("text").alias("digest"), "error", F.when(way == 2, F.col("inferred")).alias("inferred"))


def all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and syntax checks of the samples, as one scan."""
    python, web = view(spark, sf_dir, "python_files"), view(spark, sf_dir, "web_files")
    files = python.unionByName(web)
    parts = [astscan.python_findings(files), astscan.regex_findings(files), textscan.js_empty_catch(files), textscan.js_debug(files)]
    return findings.dedupe(findings.union(parts))


def _manifest(name: str, scan) -> tuple:
    chosen = {k: (p, t, f if k in name.split() else []) for k, (p, t, f) in samples.MANIFESTS.items()}
    return _on("manifest_files", scan, "repo", "rev", "path", "line", "message"), samples.expected(chosen, "line, message")


RULE_CLASSES = {
    "a1_dead_code": ("Q5",), "a2_iteration_mutation": ("Q8",), "a3_recursion": ("Q9",), "a4_resource_leaks": ("Q11",), "a5_mutable_defaults": ("Q13",),
    "a6_empty_catch": ("M1",), "a7_magic_numbers": ("M11",), "a8_stubs": ("M12",), "a9_broad_catch": ("M16",), "a10_debug_leftovers": ("M17",),
}


def _ast(classes: tuple[str, ...]) -> tuple:
    return _on("python_files", lambda f: astscan.python_findings(f, list(classes))), samples.expected(samples.PYTHON, _FINDING, _classes(*classes))


_DRIFT = """
SELECT repo, rev, path, 1 AS line, 'D2' AS class_id, message, false AS blocking FROM (
  SELECT m.repo, m.rev, m.path, CASE WHEN count(p.path) = 0 THEN 'manifest has no lockfile' WHEN bool_or(mc.path IS NOT NULL) AND NOT bool_or(pc.path IS NOT NULL)
    THEN 'manifest changed without its lockfile' WHEN NOT bool_or(mc.path IS NOT NULL) AND bool_or(pc.path IS NOT NULL) THEN 'lockfile changed alone' END AS message
  FROM (SELECT DISTINCT repo, rev, path, lock FROM manifest_paths JOIN (VALUES ('package.json', 'yarn.lock'), ('package.json', 'package-lock.json'), ('pyproject.toml', 'poetry.lock'),
      ('Cargo.toml', 'Cargo.lock'), ('go.mod', 'go.sum')) AS l(name, lock) ON ends_with(path, '/' || name)) AS m
  LEFT JOIN (SELECT DISTINCT repo, rev, path FROM manifest_paths) AS p ON p.repo = m.repo AND p.path = split_part(m.path, '/', 1) || '/' || m.lock
  LEFT JOIN (SELECT DISTINCT repo, path FROM manifest_changes) AS mc ON mc.repo = m.repo AND mc.path = m.path
  LEFT JOIN (SELECT DISTINCT repo, path FROM manifest_changes) AS pc ON pc.repo = p.repo AND pc.path = p.path
  GROUP BY ALL) WHERE message IS NOT NULL"""
#: What s_suppkey modulo 4 leaves of the seven files of a tree, and so what is declared and imported.
_UNUSED_PYTHON = """
SELECT 'repo' || CAST(s_suppkey AS VARCHAR) AS repo, 'head' AS rev, path, 1 AS line, 'D5' AS class_id, message, false AS blocking FROM supplier JOIN (VALUES
  (1, 'requirements.txt', '''unused_lib'' is declared but never imported'), (1, 'src/helper.py', '''pandas'' is imported but not declared'),
  (1, 'src/helper.py', '''requests'' is imported but not declared'),
  (2, 'requirements.txt', '''unused_lib'' is declared but never imported'), (2, 'pyproject.toml', '''other'' is declared but never imported'),
  (2, 'src/helper.py', '''pandas'' is imported but not declared'), (2, 'src/helper.py', '''requests'' is imported but not declared'),
  (3, 'requirements.txt', '''unused_lib'' is declared but never imported'), (3, 'pyproject.toml', '''other'' is declared but never imported'),
  (3, 'src/main.py', '''requests'' is imported but not declared'),
  (0, 'pyproject.toml', '''other'' is declared but never imported'), (0, 'src/helper.py', '''pandas'' is imported but not declared'),
  (0, 'src/helper.py', '''requests'' is imported but not declared'), (0, 'src/helper.py', '''pkg'' is imported but not declared'), (0, 'src/main.py', '''yaml'' is imported but not declared')
) AS t(k, path, message) ON s_suppkey % 4 = k"""
_UNUSED_JS = """
SELECT 'repo' || CAST(s_suppkey AS VARCHAR) AS repo, 'head' AS rev, path, 1 AS line, 'D5' AS class_id, message, false AS blocking FROM supplier JOIN (VALUES
  ('package.json', '''left-pad'' is declared but never imported'), ('web/index.ts', '''query'' is imported but not declared')
) AS t(path, message) ON s_suppkey % 4 <> 1"""
QUERIES = {
    **{name: _ast(classes) for name, classes in RULE_CLASSES.items()},
    "a11_python_imports": (
        imports,
        """
SELECT 'repo' || CAST(s_suppkey AS VARCHAR) AS repo, 'head' AS rev, path, name FROM supplier JOIN (VALUES (2, 'src/main.py', 'numpy'), (2, 'src/main.py', 'os'), (2, 'src/main.py', 'yaml'),
  (2, 'src/main.py', 'requests'), (3, 'src/helper.py', 'main'), (3, 'src/helper.py', 'requests'), (3, 'src/helper.py', 'pandas'), (3, 'src/helper.py', 'pkg')) AS t(k, path, name)
  ON s_suppkey % 4 <> k % 4 OR k = 2""",
    ),
    "t3_js_empty_catch": (_on("web_files", textscan.js_empty_catch), samples.expected(samples.WEB, _FINDING, _classes("M1"))),
    "t7_t8_regex_python": (_on("python_files", astscan.regex_findings), samples.expected(samples.PYTHON, _FINDING, _classes("Q3"))),
    "t7_t8_regex_js": (_on("web_files", astscan.regex_findings), samples.expected(samples.WEB, _FINDING, _classes("Q3"))),
    "t8_regex_patterns": (
        regex_patterns,
        """SELECT pattern, hazard, count(*) AS places FROM part JOIN (VALUES (12, 11, '(a+)+', 'nested quantifier'), (12, 11, '(x|x)*y', 'overlapping alternation under a quantifier'), (12, 11, '(a|b)+', NULL),
          (12, 11, '(ab{2,3})*', 'nested quantifier'), (3, 1, '(a*)*b', 'nested quantifier'), (3, 1, '[/]+c', NULL), (3, 1, '(z|z)+', 'overlapping alternation under a quantifier'))
          AS t(n, k, pattern, hazard) ON p_partkey % n = k GROUP BY pattern, hazard""",
    ),
    "t9_conflict_markers": _rules("conflict", filescan.conflict_markers),
    "t10_weak_hash_text": (
        _on("tree_files", lambda f: filescan.weak_hash_text(f).select("repo", "rev", "path", "line", "message")),
        samples.expected({k: (p, t, [r[1:] for r in f] if k == "hash-js" else []) for k, (p, t, f) in samples.TREE.items()}, "line, message"),
    ),
    "t11_weak_hash_python": (
        _on("tree_files", lambda f: filescan.weak_hash_python(f.filter("path not like 'eval/%'")).select("repo", "rev", "path", "line", "message")),
        samples.expected({k: (p, t, [r[1:] for r in f] if k in ("hash-py", "hash-broken") else []) for k, (p, t, f) in samples.TREE.items()}, "line, message"),
    ),
    "t12_dockerfile_root": (
        _on("tree_files", lambda f: filescan.dockerfile_root(f).select("repo", "rev", "path", "line", "message")),
        samples.expected({k: (p, t, [r[1:] for r in f] if k.startswith("docker") else []) for k, (p, t, f) in samples.TREE.items()}, "line, message"),
    ),
    "t13_manifest_root": (
        _on("tree_files", lambda f: filescan.manifest_root(f).select("repo", "rev", "path", "line", "message")),
        samples.expected({k: (p, t, [r[1:] for r in f] if k in ("compose", "pod", "bad-yaml") else []) for k, (p, t, f) in samples.TREE.items()}, "line, message"),
    ),
    "t15_compliance_scan": (compliance, samples.expected(samples.TREE, "check_name, line, message")),
    "u11_run_code_checks": (
        all_checks,
        samples.expected(samples.PYTHON, _FINDING) + " UNION ALL " + samples.expected(samples.WEB, _FINDING),
    ),
    "u1_unpinned_package_json": _manifest("package", dependencies.unpinned_package_json),
    "u2_unpinned_requirements": _manifest("requirements", dependencies.unpinned_requirements),
    "u3_unpinned_pyproject": _manifest("pyproject", dependencies.unpinned_pyproject),
    "u4_unpinned_cargo": _manifest("cargo", dependencies.unpinned_cargo),
    "d1_unpinned": _manifest("package requirements pyproject cargo", dependencies.unpinned),
    "d2_lockfile_drift": (lockfiles, with_views(_DRIFT, "manifest_paths", "manifest_changes")),
    "d4_unused_python_deps": (_on("import_trees", dependencies.unused_python), _UNUSED_PYTHON),
    "d5_unused_js_deps": (_on("import_trees", dependencies.unused_js), _UNUSED_JS),
    "s2_s3_decoded": (
        odd_encodings,
        "SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error, CASE WHEN doc_id % 5 = 2 THEN 'utf-16-le' END AS inferred FROM documents",
    ),
}
