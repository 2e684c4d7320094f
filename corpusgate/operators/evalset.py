"""Evaluation cases: their structure, and how reports compare with what a case expects.

`cases` has slug, expected (JSON text), files (map of name to text) and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.text import splitlines
from corpusgate.operators.reports import as_text, field, kind, parse_reports, process_narration

#: Modes, verdicts and keys of a case.
MODES = ["PR", "File", "Piece", "Wholesale"]
PR_VERDICTS = ["APPROVE", "BLOCK", "NEEDS-HUMAN"]
KEYS = ["mode", "expected_verdict", "expected_classes", "expect_json", "notes"]
STATUS_SECONDS = 600


def verdict_fits_mode(mode: Column, verdict: Column) -> Column:
    return (
        F.when(mode == "PR", verdict.isin(PR_VERDICTS))
        .when(mode == "Piece", verdict.startswith("RISK (partial)") | verdict.startswith("NEEDS-HUMAN"))
        .when(mode.isin("File", "Wholesale"), verdict.startswith("RISK:"))
        .otherwise(False)
    )


def validate_cases(cases: DataFrame, known: list[str]) -> DataFrame:
    """slug, n, problem of each case; known are the policy's class ids."""
    rows = cases.withColumn("data", F.try_parse_json("expected"))
    data = F.col("data")
    get = lambda name: field(data, name)
    mode, verdict = as_text(get("mode")), as_text(get("expected_verdict"))
    absent = F.filter(F.array(*[F.when(get(k).isNull(), F.lit(f"missing key '{k}'")) for k in KEYS]), lambda x: x.isNotNull())
    classes = F.coalesce(F.try_variant_get(get("expected_classes"), "$", "array<string>"), F.array().cast("array<string>"))
    strange = F.filter(classes, lambda c: ~F.array_contains(F.array(*[F.lit(k) for k in known]), c))
    elapsed, status = get("active_work_elapsed_seconds"), get("expected_review_status")
    is_null = lambda v: v.isNull() | (kind(v) == "VOID")
    seconds = F.try_variant_get(elapsed, "$", "bigint")
    found = F.concat(
        F.array_compact(F.array(F.when(~verdict_fits_mode(mode, verdict), F.concat(F.lit("verdict '"), verdict, F.lit("' does not fit mode "), mode)))),
        F.transform(strange, lambda c: F.concat(F.lit("unknown class '"), c, F.lit("'"))),
        F.array_compact(
            F.array(
                F.when(kind(get("expect_json")) != "BOOLEAN", "expect_json must be a boolean"),
                F.when(F.coalesce(F.trim(as_text(get("notes"))), F.lit("")) == "", "notes must be a non-empty string"),
                F.when(~is_null(elapsed) & ((kind(elapsed) != "BIGINT") | (seconds < 0)), "active_work_elapsed_seconds must be a non-negative integer"),
                F.when(~is_null(status) & ~F.coalesce(as_text(status) == "NEEDS-HUMAN", F.lit(False)), "expected_review_status must be NEEDS-HUMAN"),
                F.when(kind(get("forbid_process_narration")) != "BOOLEAN", "forbid_process_narration must be a boolean"),
            )
        ),
    )
    inputs = F.filter(F.map_keys("files"), lambda n: n.startswith("input."))
    fixture = F.when(F.coalesce(mode == "PR", F.lit(False)), F.when(~F.map_contains_key("files", "diff.patch"), "PR mode requires diff.patch")).otherwise(
        F.when(F.size(inputs) == 0, "non-PR mode requires an input.<ext> file")
    )
    shape = (
        F.when(data.isNull() | (kind(data) != "OBJECT"), F.array(F.lit("unreadable case")))
        .when(F.size(absent) > 0, absent)
        .when(~F.coalesce(mode.isin(MODES), F.lit(False)), F.array(F.concat(F.lit("invalid mode '"), F.coalesce(mode, F.lit("")), F.lit("'"))))
        .otherwise(found)
    )
    return rows.select("slug", F.posexplode(F.concat(shape, F.array_compact(F.array(fixture)))).alias("n", "problem"))


def verdict_matches(mode: Column, expected: Column, label: Column, value: Column, token: Column) -> Column:
    """Whether a final line carries the expected verdict as a whole token."""
    final = F.concat(label, F.lit(": "), value)
    rest = F.substr(final, F.char_length(expected) + 1)
    whole = final.startswith(expected) & ((rest == "") | ~rest.rlike("(?U)^[\\p{IsAlphabetic}\\p{IsDigit}-]"))
    return F.coalesce(F.when(mode == "PR", (label == "VERDICT") & (token == expected)).when(expected == "NEEDS-HUMAN", token == expected).otherwise(whole), F.lit(False))


def class_failures(payload: Column, expected: Column) -> Column:
    """Array of failures: classes that are missing, then those that are unexpected, each sorted."""
    items = F.coalesce(F.try_variant_get(payload, "$.findings", "array<variant>"), F.array().cast("array<variant>"))
    reported = F.array_distinct(F.array_compact(F.transform(items, lambda x: as_text(field(x, "class")))))
    missing = F.transform(F.array_sort(F.array_except(expected, reported)), lambda c: F.concat(F.lit("missing expected class "), c))
    extra = F.transform(F.array_sort(F.array_except(reported, expected)), lambda c: F.concat(F.lit("unexpected class "), c))
    given = field(payload, "findings")
    return F.when(given.isNotNull() & (kind(given) != "ARRAY"), F.array(F.lit("VERDICT_JSON findings must be an array"))).otherwise(F.concat(missing, extra))


def evaluate_responses(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """slug, mode, expected_classes, failures, passed. cases has slug, mode, expected_verdict, expected_classes, expect_json,
    forbid_process_narration, expected_review_status; reports has slug and text."""
    rows = parse_reports(cases.join(reports, "slug"))
    final = F.coalesce(F.concat("label", F.lit(": "), "value"), F.lit(""))
    status = F.concat(F.lit("REVIEW STATUS: "), "expected_review_status")
    told = F.exists(splitlines(F.col("text")), lambda x: x.startswith(status))
    match = verdict_matches(*[F.col(c) for c in ("mode", "expected_verdict", "label", "value", "token")])
    head = F.array_compact(
        F.array(
            F.when(F.coalesce("forbid_process_narration", F.lit(False)) & process_narration(F.col("text")), "report contains process narration"),
            F.when(~match, F.concat(F.lit("expected verdict '"), "expected_verdict", F.lit("' in final line '"), final, F.lit("'"))),
            F.when(F.col("expected_review_status").isNotNull() & ~told, F.concat(F.lit("missing expected review status "), "expected_review_status")),
            F.when(F.col("expect_json") & F.col("payload").isNull(), F.col("json_error")),
        )
    )
    none = F.array().cast("array<string>")
    tail = F.when(F.col("payload").isNotNull(), class_failures(F.col("payload"), F.col("expected_classes"))).otherwise(none)
    out = rows.select("slug", "mode", "expected_classes", F.concat(head, tail).alias("failures"))
    return out.withColumn("passed", F.size("failures") == 0)


def pass_rate(results: DataFrame) -> DataFrame:
    """mode, class_id, passed, total, with subtotals (null): a case counts under each class that it expects."""
    rows = results.select("slug", "mode", "passed", F.explode_outer("expected_classes").alias("class_id"))
    rows = rows.withColumn("class_id", F.coalesce("class_id", F.lit("none")))
    return rows.rollup("mode", "class_id").agg(
        F.count_distinct(F.when(F.col("passed"), F.col("slug"))).alias("passed"), F.count_distinct("slug").alias("total")
    )


def timeout_status(cases: DataFrame) -> DataFrame:
    """cases with review_status: NEEDS-HUMAN once active work took STATUS_SECONDS."""
    return cases.withColumn("review_status", F.when(F.col("active_work_elapsed_seconds") >= STATUS_SECONDS, "NEEDS-HUMAN"))
