"""The three workloads as jobs over tables: changes to envelopes, reports to a gate, trees and history to violations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.operators import astscan, commits, dependencies, diffs, filescan, findings, packing, reports, textscan, verdicts
from corpusgate.operators.ranges import written

TREE = ["repo", "rev"]
FILE_SCANS = (
    textscan.incomplete_markers,
    textscan.suppressions,
    textscan.js_empty_catch,
    textscan.js_debug,
    textscan.hardcoded_env,
    astscan.python_findings,
    astscan.regex_findings,
    dependencies.unpinned,
)


class Prescan(NamedTuple):
    """prescan: findings with ids; unreviewed: key, path, reason; packed and envelopes by chunk."""

    prescan: DataFrame
    unreviewed: DataFrame
    packed: DataFrame
    envelopes: DataFrame


def run_checks(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of the named file checks (all by default) over files, each finding once."""
    known = {name: class_id for name, class_id, _, project in findings.CHECKS if not project}
    wanted = [known[n] for n in names] if names else list(known.values())
    return findings.dedupe(findings.union([scan(files) for scan in FILE_SCANS])).filter(F.col("class_id").isin(wanted))


def project_checks(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings of whole trees: lockfiles, unused packages, changes without a test. changes: repo, rev, ord, path."""
    parts = [dependencies.lockfile_drift(tree, changes), dependencies.unused_python(tree), dependencies.unused_js(tree), dependencies.untested_changes(changes, TREE)]
    return findings.union(parts)


def prescan_changes(changes: DataFrame, tree: DataFrame, prs: DataFrame, exclude: tuple[str, ...] = (), budget: int | None = None, chunks: int | None = packing.MAX_CHUNKS) -> Prescan:
    """Change sets, with their trees, to envelopes.

    changes: repo, rev, ord, path, patch, is_binary, decodable. tree: repo, rev, path, text. prs: repo, rev, metadata,
    context and paths. chunks: the most of a change set, None for no limit. Scans see only changed files that aren't excluded; only (path, size) reach the step that packs."""
    shown = changes.filter("not is_binary and decodable and coalesce(patch, '') <> ''")
    scanned = shown.filter(~diffs.match_globs(F.col("path"), exclude)).select(*TREE, "path").distinct()
    files = tree.join(scanned, [*TREE, "path"], "left_semi")
    unparsed = astscan.unparsed(files)
    found = run_checks(files).unionByName(project_checks(tree, changes.select(*TREE, "ord", "path")))
    kept = diffs.keep_on_added(found, changes, diffs.added_ranges(shown, TREE), TREE, exclude)
    # Findings and places in chunks are narrow, and several results read them: they are written, so that files are scanned once.
    prescan = written(findings.with_prescan_ids(findings.dedupe(kept), TREE), "prescan")
    if budget is None:
        item = F.struct("id", F.col("path").alias("file"), "line", F.col("class_id").alias("class"), "message", "blocking")
        items = prescan.groupBy(*TREE).agg(F.collect_list(item).alias("prescan"))
        none = F.array().cast(items.schema["prescan"].dataType)
        left = prs.join(items, TREE, "left").withColumn("prescan", F.coalesce("prescan", none))
        budgets = packing.chunk_budget(left).select(*TREE, "budget")
        sizes = packing.measured(shown).join(budgets, TREE)
        packed = packing.pack_chunks(sizes, TREE, F.col("budget"))
    else:
        packed = packing.pack_chunks(packing.measured(shown), TREE, budget)
    packed = written(packing.limit_chunks(packed, chunks), "packed")
    unreviewed = packing.unreviewed_files(changes, packed, TREE, unparsed)
    envelopes = packing.build_envelopes(shown, packed, prescan, prs.select(*TREE, "metadata", "context"), TREE)
    return Prescan(prescan, unreviewed, packed, envelopes)


def gate_reports(answers: DataFrame, contexts: DataFrame, classes: DataFrame, prs: DataFrame, prescan: DataFrame, unreviewed: DataFrame, key: list[str]) -> DataFrame:
    """Reports of chunks to one verdict for each change set, and whether its gate fails.

    answers and contexts are keyed by key and chunk; an invalid report counts as NEEDS-HUMAN."""
    chunk = [*key, "chunk"]
    checked = reports.validate_reports(answers, contexts, classes, chunk)
    valid = F.size("problems") == 0
    chunks = checked.select(*chunk, F.when(valid, F.coalesce("token", F.lit("NEEDS-HUMAN"))).otherwise("NEEDS-HUMAN").alias("verdict"), "problems")
    return verdicts.gate(verdicts.result_table(verdicts.merge_verdicts(prs, chunks, prescan, unreviewed, key), chunks, prescan, unreviewed, key))


def audit(files: DataFrame, history: DataFrame, branches: DataFrame, approved: DataFrame) -> DataFrame:
    """repo, subject, rule, violation: a whole tree's files, its commits and branches, in one table."""
    tree = filescan.compliance_scan(files, limit=None)
    told = F.concat_ws(":", "path", F.when(F.col("line") > 0, F.col("line").cast("string")))
    rows = [tree.select("repo", told.alias("subject"), F.col("check").alias("rule"), F.col("message").alias("violation"))]
    banned = commits.banned_authors(history).withColumn("violation", F.concat(F.lit("banned "), "role", F.lit(" "), "name"))
    parts = {
        "subject": commits.subject_violations(history),
        "co-author": commits.coauthor_violations(history, approved),
        "identity": commits.identity_violations(history),
        "banned": banned,
    }
    rows += [part.select("repo", F.substring("sha", 1, 12).alias("subject"), F.lit(rule).alias("rule"), "violation") for rule, part in parts.items()]
    rows.append(commits.branch_violations(branches).select("repo", F.col("branch").alias("subject"), F.lit("branch").alias("rule"), "violation"))
    return findings.union(rows)
