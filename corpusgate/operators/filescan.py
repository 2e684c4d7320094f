"""Scans that read a file as a whole, each behind a filter on its name and, where a pattern allows it, on its text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import filerules
from corpusgate.functions.ship import ship
from corpusgate.functions.text import file_name, suffix
from corpusgate.operators.content import scan_distinct_blobs
from corpusgate.operators.findings import capped, union

#: What each scan looks at.
CODE = [".c", ".cc", ".cjs", ".cpp", ".cs", ".go", ".java", ".js", ".jsx", ".mjs", ".php", ".py", ".pyw", ".rb", ".rs", ".ts", ".tsx"]
MARKDOWN = "(?i)\\.(md|markdown|mdown|mkdn|mdx)$"
FIXTURES = "eval/cases/"
MAX_ROWS = 1000
_ROWS = "array<struct<line:int,message:string>>"
_KIND = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))

Rule = Callable[[str, str], Iterator[tuple[int, str]]]


def _by_rule(files: DataFrame, rule: Rule, check: str) -> DataFrame:
    """The columns of files but text, with check, line, message of what the rule finds in each text."""
    ship(files.sparkSession)
    names = [c for c in files.columns if c != "text"]
    rows = files.select(*names, "text")
    n, path = len(names), names.index("path")

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"line": a, "message": b} for a, b in rule(text.as_py() or "", where.as_py() or "")]
                for text, where in zip(batch.column(n), batch.column(path), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(found, _KIND)], [*names, "found"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    out = rows.mapInArrow(ruled, f"{kinds}, found {_ROWS}")
    return out.select(*names, F.lit(check).alias("check"), F.explode("found").alias("f")).select(*names, "check", "f.line", "f.message")


def conflict_markers(files: DataFrame, size: int | None = None, limit: int | None = filerules.MAX_CONFLICTS, width: int | None = filerules.MAX_LINE) -> DataFrame:
    """Conflicts of each file. limit: findings of a file, after which a row says so; width: characters of a line that are read; None: no limit."""
    hit = files.filter(F.col("text").rlike("(?m)^[<>=|]"))
    return _by_rule(hit, lambda text, path: filerules.conflicts(text, _is_markdown(path), size, limit, width), "conflict")


def _is_markdown(path: str) -> bool:
    return path.lower().endswith((".md", ".markdown", ".mdown", ".mkdn", ".mdx"))


def _lower(path: str = "path") -> Column:
    return F.lower(path)


def weak_hash_text(files: DataFrame, limit: int | None = filerules.MAX_HASHES) -> DataFrame:
    """limit: findings of a file, after which a row says so; None: no limit."""
    code = files.filter(suffix(_lower()).isin([s for s in CODE if s not in (".py", ".pyw")]) & F.col("text").rlike("(?i)md5|sha-?1"))
    return _by_rule(code, lambda text, path: filerules.weak_hash_text(text, limit), "weak-hash")


def weak_hash_python(files: DataFrame, limit: int | None = filerules.MAX_HASHES) -> DataFrame:
    """Every Python file, as one that can't be parsed is a finding too. limit: as for weak_hash_text."""
    return _by_rule(files.filter(suffix(_lower()).isin([".py", ".pyw"])), lambda text, path: filerules.weak_hash_python(text, limit), "weak-hash")


def is_dockerfile(path: Column) -> Column:
    return F.lower(file_name(path)).rlike("^(dockerfile|containerfile)($|[.-])")


def is_yaml(path: Column) -> Column:
    return F.lower(path).rlike("\\.ya?ml$")


def dockerfile_root(files: DataFrame) -> DataFrame:
    return _by_rule(files.filter(is_dockerfile(F.col("path"))), lambda text, path: filerules.dockerfile_root(text), "root-user")


def manifest_root(files: DataFrame) -> DataFrame:
    return _by_rule(files.filter(is_yaml(F.col("path")) & ~is_dockerfile(F.col("path"))), lambda text, path: filerules.manifest_root(text), "root-user")


def is_workflow(path: Column) -> Column:
    lower = F.lower(path)
    action = lower.startswith(".github/actions/") & file_name(lower).isin("action.yml", "action.yaml")
    return lower.startswith(".github/workflows/") & is_yaml(path) | action


def action_pins(files: DataFrame) -> DataFrame:
    """References at any depth; the strict rule."""
    return _by_rule(files.filter(is_workflow(F.col("path"))), lambda text, path: filerules.action_references(text), "action-pin")


def critical_links(files: DataFrame) -> DataFrame:
    """Symbolic links where trusted files should be."""
    path = F.col("path")
    critical = path.isin("requirements-checkers.txt", "scripts/trusted_git.py") | path.startswith("scripts/check_") | path.startswith(".github/workflows/")
    names = [c for c in files.columns if c != "text"]
    hit = files.filter((F.col("mode") == "120000") & critical)
    message = F.lit("trusted compliance files must not be symlinks")
    return hit.select(*names, F.lit("link").alias("check"), F.lit(0).alias("line"), message.alias("message"))


def dispatch_key() -> Column:
    """How a path is scanned: by kind of name, and whether it is a fixture. A link isn't scanned."""
    path = F.col("path")
    fixture = F.lower(path).startswith(FIXTURES)
    kind = F.when(is_dockerfile(path), "docker").when(is_yaml(path), "yaml").when(suffix(F.lower(path)).isin(CODE), suffix(F.lower(path))).otherwise("other")
    marks = F.when(path.rlike(MARKDOWN), "markdown").otherwise("")
    return F.when(F.col("mode") == "120000", "link").otherwise(
        F.concat_ws("|", kind, fixture.cast("string"), is_workflow(path).cast("string"), marks)
    )


def compliance_scan(files: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """repo, rev, path, check, line, message over whole trees: every rule on the files it is for, each distinct blob once.

    files: repo, rev, path, blob_id, mode, text. Fixtures aren't held to the rule on hashes. Beyond `limit` findings of
    a tree, one row says so; conflicts are looked for only in trees below it. None: no limit,
    in any file either."""
    tree = ["repo", "rev"]
    names = ["repo", "rev", "path", "blob_id", "mode"]

    def scan(rows: DataFrame) -> DataFrame:
        code = rows.filter(~F.lower("path").startswith(FIXTURES))
        each = filerules.MAX_HASHES if limit is not None else None
        plain = [action_pins(rows), weak_hash_text(code, each), weak_hash_python(code, each), dockerfile_root(rows), manifest_root(rows)]
        return union([p.select("blob_id", "dispatch", "check", "line", "message") for p in plain])

    held = files.select(*names, "text")
    rules = scan_distinct_blobs(held.filter("mode <> '120000'"), dispatch_key(), scan).select(*tree, "path", "check", "line", "message")
    rules = rules.unionByName(critical_links(held).select(*tree, "path", "check", "line", "message"))
    rest = held.filter("mode <> '120000'")
    if limit is not None:
        full = rules.groupBy(*tree).count().filter(F.col("count") >= limit).select(*tree)
        rest = rest.join(full, tree, "left_anti")
    conflicts = scan_distinct_blobs(
        rest, dispatch_key(), lambda rows: (conflict_markers(rows) if limit is not None else conflict_markers(rows, limit=None, width=None)).select("blob_id", "dispatch", "check", "line", "message")
    ).select(*tree, "path", "check", "line", "message")

    if limit is None:
        return rules.unionByName(conflicts)

    def sentinel(units: DataFrame) -> DataFrame:
        told = F.lit(f"reached violation limit ({limit}), stopping")
        return units.select(*tree, F.lit("").alias("path"), F.lit("limit").alias("check"), F.lit(0).alias("line"), told.alias("message"))

    return capped(rules, tree, ["path", "line", "check", "message"], limit, sentinel).unionByName(conflicts)
