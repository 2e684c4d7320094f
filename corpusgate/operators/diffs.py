"""Change sets: patches of a combined diff, added lines, and what of the findings falls on them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.text import LINE_END
from corpusgate.operators.findings import PROJECT_CLASSES

HUNK = "@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)(?:,[0-9]+)? @@"
#: Before each hunk's header, at whatever ends a line.
_HUNKS = f"(?:\\A|(?<=[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]))(?={HUNK})"

_ODD_ENDS = "[\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def split_patches(diffs: DataFrame, key: list[str], diff: str = "diff") -> DataFrame:
    """key, ord (from 1), patch: one row for each file of a combined diff. A diff without a file header is one patch."""
    parts = F.filter(F.split(F.col(diff), "(?m)^(?=diff --git )", -1), lambda p: p != "")
    return diffs.select(*key, F.posexplode(parts).alias("ord", "patch")).withColumn("ord", F.col("ord") + 1)


def added_numbers(patch: Column) -> Column:
    """Line numbers, in the new file, of the lines that a patch adds, hunk by hunk, in time linear in the patch.

    A hunk header sets the number; added and unchanged lines move it on, others don't; what comes before the first
    hunk is no content."""

    def numbers(hunks: Column, ends: str) -> Column:
        def of_hunk(hunk: Column) -> Column:
            # The start is read once for a hunk, not for each of its lines.
            start = F.coalesce(F.regexp_extract(hunk, "^" + HUNK, 1).try_cast("int"), F.lit(0))
            content = F.filter(F.split(hunk, ends, -1), lambda line: line.startswith("+") | line.startswith(" "))
            from_start = lambda s: F.transform(content, lambda line, i: F.when(line.startswith("+"), s + i))
            return F.array_compact(F.element_at(F.transform(F.array(start), from_start), 1))

        return F.flatten(F.transform(hunks, of_hunk))

    # Line feeds alone, nearly all patches, are cut at a sign; what stands before the first hunk is the first part.
    plain = F.filter(F.split(F.concat(F.lit("\n"), patch), f"\n(?={HUNK})", -1), lambda part, i: i > 0)
    odd = F.filter(F.split(patch, _HUNKS, -1), lambda part: part.rlike("^" + HUNK))
    return F.when(patch.rlike(_ODD_ENDS), numbers(odd, LINE_END)).otherwise(numbers(plain, "\n"))


def added_lines(changes: DataFrame, key: list[str]) -> DataFrame:
    """key, path, line of each added line. It works inside each patch, so nothing is shuffled."""
    return changes.select(*key, "path", F.explode(added_numbers(F.col("patch"))).alias("line"))


def added_ranges(changes: DataFrame, key: list[str]) -> DataFrame:
    """key, path, ranges (array<struct<first, last>>) of each patch: one narrow row, however many they are."""
    rows = changes.select(*key, "path", added_numbers(F.col("patch")).alias("numbers"))
    beside = lambda i, by: F.get("numbers", i + by)
    first = F.filter("numbers", lambda n, i: ~beside(i, -1).eqNullSafe(n - 1))
    last = F.filter("numbers", lambda n, i: ~beside(i, 1).eqNullSafe(n + 1))
    return rows.select(*key, "path", F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("ranges"))


def glob_pattern(globs: Iterable[str]) -> str:
    """One anchored pattern for shell globs of which any may match; * and ? take slashes too."""
    out = []
    for glob in globs:
        parts = re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.DOTALL)
        one = ""
        for part in parts:
            if part == "*":
                one += ".*"
            elif part == "?":
                one += "."
            elif len(part) > 1:
                inside = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                one += "[" + ("^" + inside[1:] if inside.startswith("!") else "\\" + inside if inside.startswith("^") else inside) + "]"
            else:
                one += re.escape(part)
        out.append(one)
    return "(?s)^(?:" + "|".join(out) + ")$" if out else "(?!)"


def match_globs(path: Column, globs: Iterable[str]) -> Column:
    return path.rlike(glob_pattern(globs))


def _on_added(findings: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Findings on lines within the ranges of added, as `added_ranges` gives them; files meet, and the line is looked for in the row."""
    within = F.exists(added["ranges"], lambda r: (findings["line"] >= r["first"]) & (findings["line"] <= r["last"]))
    same = [findings[k].eqNullSafe(added[k]) for k in [*key, "path"]]
    return findings.join(added, [*same, within], "left_semi")


def keep_on_added(findings: DataFrame, changes: DataFrame, added: DataFrame, key: list[str], exclude: Iterable[str] = ()) -> DataFrame:
    """Findings of changed, not excluded files that lie on added lines or are of a project class.

    added: the ranges of lines that these changes add (`added_ranges`)."""
    kept = findings.filter(~match_globs(F.col("path"), exclude))
    project = F.col("class_id").isin(PROJECT_CLASSES)
    whole = kept.filter(project).join(changes.select(*key, "path").distinct(), [*key, "path"], "left_semi")
    return _on_added(kept.filter(~project), added, key).unionByName(whole)


def keep_in_batch(findings: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """The rule for a scan without a change set: project classes stay, whatever their path."""
    project = F.col("class_id").isin(PROJECT_CLASSES)
    return _on_added(findings.filter(~project), added, key).unionByName(findings.filter(project))


def latest_first(changes: DataFrame, key: list[str]) -> DataFrame:
    """Changes with their place in the set, for sources that give none."""
    return changes.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
