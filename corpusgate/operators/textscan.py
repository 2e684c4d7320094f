"""Line and pattern scans: filters on the whole text first, lines only of the texts that hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.text import CONFIG, JS, SOURCE, explode_lines, is_documentation_host, is_test_path, line_of, match_starts, suffix
from corpusgate.operators.findings import finding

TREE = ["repo", "rev"]
#: Patterns of the scans.
MARKERS = "\\b(?:TODO|FIXME|XXX|HACK)\\b"
SUPPRESSIONS = ["# noqa", "eslint-disable", "type: ignore", "@ts-ignore", "@ts-nocheck", "pylint: disable", "//nolint", "// nolint"]
ALLOWED_TO_FAIL = "^\\s*continue-on-error:\\s*true\\b"
EMPTY_CATCH = "\\bcatch\\s*(?:\\([^)]*\\))?\\s*\\{\\s*\\}"
DEBUGGER = "^\\s*debugger\\s*;?\\s*$"
CONSOLE_LOG = "\\bconsole\\.log\\s*\\("
URL = "https?://([A-Za-z0-9.-]+)"
IPV4 = "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9.])"
USER_PATH = "[\"'](?:/home/|/Users/|[A-Za-z]:\\\\)"
USES = "^\\s*-?\\s*uses:\\s*['\"]?([^'\"\\s#]+)"


def _of_kind(files: DataFrame, kinds: list[str]) -> DataFrame:
    return files.filter(suffix(F.col("path")).isin(kinds))


def incomplete_markers(files: DataFrame) -> DataFrame:
    """Deferred-work words in code and configuration; one finding a line."""
    lines = explode_lines(_of_kind(files, SOURCE + CONFIG), [*TREE, "path"], MARKERS)
    return lines.select(*TREE, "path", *finding("M12", "deferred-work marker", True))


def suppressions(files: DataFrame) -> DataFrame:
    """Suppressed checks in code and configuration and, in workflows, steps that may fail; one finding a line."""
    markers = "|".join("\\Q" + s + "\\E" for s in SUPPRESSIONS)
    lines = explode_lines(_of_kind(files, SOURCE + CONFIG), [*TREE, "path"], f"{markers}|continue-on-error:")
    weakened = F.col("path").contains(".github/workflows/") & F.col("line_text").rlike(ALLOWED_TO_FAIL)
    message = F.when(F.col("line_text").rlike(markers), "check suppression").when(weakened, "CI step allowed to fail")
    return lines.select(*TREE, "path", *finding("M13", message, True)).filter("message is not null")


def js_empty_catch(files: DataFrame) -> DataFrame:
    """Catch blocks without content, over lines; a finding for each."""
    hit = _of_kind(files, JS).filter(F.col("text").rlike(EMPTY_CATCH))
    starts = hit.select(*TREE, "path", "text", F.explode(match_starts(F.col("text"), EMPTY_CATCH)).alias("start"))
    return starts.select(*TREE, "path", *finding("M1", "empty catch block", True, line_of(F.col("text"), F.col("start"))))


def js_debug(files: DataFrame) -> DataFrame:
    """Debugger statements, else console.log calls, in JavaScript and TypeScript."""
    lines = explode_lines(_of_kind(files, JS), [*TREE, "path"], "debugger|console\\.log")
    message = F.when(F.col("line_text").rlike(DEBUGGER), "debugger statement").when(
        F.col("line_text").rlike(CONSOLE_LOG), "console.log call left in code"
    )
    return lines.select(*TREE, "path", *finding("M17", message, False)).filter("message is not null")


def hardcoded_env(files: DataFrame) -> DataFrame:
    """In source files outside tests: URLs of real hosts, else IPv4 addresses on lines without a URL, else user paths."""
    source = _of_kind(files, SOURCE).filter(~is_test_path(F.col("path")))
    lines = explode_lines(source, [*TREE, "path"], f"{URL}|{IPV4}|{USER_PATH}")
    text = F.col("line_text")
    hosts = F.regexp_extract_all(text, F.lit(URL), F.lit(1))
    message = (
        F.when(F.exists(hosts, lambda h: ~is_documentation_host(h)), "hardcoded URL")
        .when(text.rlike(IPV4) & (F.size(hosts) == 0), "hardcoded IPv4 address")
        .when(text.rlike(USER_PATH), "hardcoded absolute user path")
    )
    return lines.select(*TREE, "path", *finding("M18", message, False)).filter("message is not null")


def unpinned_actions(files: DataFrame, strict: bool = False) -> DataFrame:
    """References of workflows and actions without a full commit id; local ones pass.

    Images pass with a digest, but not if strict."""
    flow = files.filter(F.concat(F.lit("/"), "path").contains(".github/") & suffix(F.col("path")).isin([".yml", ".yaml"]))
    lines = explode_lines(flow, [*TREE, "path"], USES)
    lines = lines.withColumn("reference", F.regexp_extract("line_text", USES, 1)).filter(~F.col("reference").startswith("./"))
    by_commit = F.col("reference").rlike("@[0-9a-f]{40}$" if not strict else "^[^@\\s]+@[0-9a-fA-F]{40}$")
    image = F.col("reference").startswith("docker://")
    pinned = by_commit if strict else F.when(image, F.col("reference").contains("@sha256:")).otherwise(by_commit)
    message = F.concat(F.lit("'"), "reference", F.lit("' is not pinned to a full SHA"))
    return lines.filter(~pinned).select(*TREE, "path", *finding("D1", message, False))
