"""Review reports: their final line and JSON, and every rule that a valid report keeps.

A report's JSON is untrusted, so it stays VARIANT and each value's kind is asked before use. `reports` has key columns
and text; `envelopes` has the same keys, mode, changed_files, prescan_ids and unreviewed (arrays of strings); `classes`
has class_id and tier. Problems carry their place in the list (rank, ord, n), so the list of a report is in order
whatever the joins do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.text import splitlines

#: Final lines, the JSON line, and what its fields may hold.
FINAL = "^(VERDICT|RISK \\(partial\\)|RISK):\\s*(\\S.*)$"
JSON_PREFIX = "VERDICT_JSON:"
SCHEMA_VERSION = "1"
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
CONFIDENCES = ["certain", "likely"]
STATUSES = ["confirmed", "dismissed"]
VERDICTS = ["APPROVE", "NEEDS-HUMAN", "BLOCK"]  # by rank
NARRATION = (
    "(?im)\\b(?:I(?:'m|'ll|'ve|'d)?\\s+(?:review|analy[sz]e|identify|need|should|must|can|cannot|can't|think|believe|see|find|verify|confirm|"
    "check|recheck|reconsider|look|start|trace|read|inspect|apply|want|have|only\\s+(?:see|have|know))\\b|let\\s+me\\b|"
    "need\\s+to\\s+(?:verify|check|confirm|read|inspect|trace)\\b|^\\s*(?:wait|actually|reconsider(?:ing)?)\\b)"
)
_ODD_ENDS = "[\\x0B\\x0C\\x1C-\\x1E]"
#: White space within a line.
_SPACE = "[^\\S\\r\\n\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
_FINALS = f"(?mU)^{_SPACE}*(?:VERDICT|RISK \\(partial\\)|RISK):{_SPACE}*\\S.*$"
_EDGES = "(?U)^\\s+|\\s+$"
_NONE = "array<string>"


def stripped(text: Column) -> Column:
    """Text without white space at its ends; the pattern, which tries every place, sees only texts that have some other than spaces there."""
    bare = F.trim(text)
    other = F.substring(bare, 1, 1).rlike("(?U)\\s") | F.substring(bare, -1, 1).rlike("(?U)\\s")
    return F.when(other, F.regexp_replace(bare, _EDGES, "")).otherwise(bare)


def verdict_rank(verdict: Column) -> Column:
    """0, 1, 2 for the verdicts, null for other tokens."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict), F.lit(0)) - 1


def verdict_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), (rank + 1).cast("int"))


def process_narration(text: Column) -> Column:
    """Whether the prose tells how the review went; an outer fence is opened, other code, JSON lines and inline code don't count.

    A text without code, and with plain line ends, needs no walk over its lines."""
    plain = F.regexp_replace(text, "(?m)^VERDICT_JSON:.*$", "").rlike(NARRATION)
    return F.coalesce(F.when(text.rlike("[`\\r" + _ODD_ENDS[1:]), _narration_by_line(text)).otherwise(plain), F.lit(False))


def _narration_by_line(text: Column) -> Column:
    lines = splitlines(text)
    fence = lambda x: stripped(x).startswith("```")
    outer = (F.size(lines) >= 2) & fence(F.try_element_at(lines, F.lit(1))) & fence(F.try_element_at(lines, F.lit(-1)))
    lines = F.when(outer, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(lines)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast(_NONE).alias("prose"))

    def step(acc: Column, line: Column) -> Column:
        mark = fence(line)
        skip = mark | acc["inside"] | line.startswith(JSON_PREFIX)
        kept = F.concat(acc["prose"], F.array(F.regexp_replace(line, "`[^`]*`", "")))
        return F.struct((acc["inside"] != mark).alias("inside"), F.when(skip, acc["prose"]).otherwise(kept).alias("prose"))

    return F.array_join(F.aggregate(lines, start, step)["prose"], "\n").rlike(NARRATION)


def kind(value: Column) -> Column:
    """What a VARIANT holds: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, ...; null for a missing one."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def as_text(value: Column) -> Column:
    """A VARIANT's string, null if it holds none."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def parse_reports(reports: DataFrame) -> DataFrame:
    """reports with label, value, token, final_lines, payload (VARIANT, an object) and json_error."""
    # Patterns know fewer line ends than splitlines does; the rest become line feeds first, in the few texts with any.
    text = F.when(F.col("text").rlike(_ODD_ENDS), F.regexp_replace("text", _ODD_ENDS, "\n")).otherwise(F.col("text"))
    rows = reports.withColumn("finals", F.regexp_extract_all(text, F.lit(_FINALS), F.lit(0)))
    rows = rows.withColumn("raw", F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?m)^{_SPACE}*{JSON_PREFIX}(.*)$"), F.lit(1)), F.lit(-1)))
    rows = rows.withColumn("data", F.try_parse_json(stripped(F.col("raw")))).withColumn("last", stripped(F.try_element_at("finals", F.lit(-1))))
    error = (
        F.when(F.col("raw").isNull(), "missing VERDICT_JSON line")
        .when(F.col("data").isNull(), "VERDICT_JSON is not valid JSON")
        .when(kind(F.col("data")) != "OBJECT", "VERDICT_JSON must be a JSON object")
    )
    rows = rows.withColumn("json_error", error).withColumn("payload", F.when(error.isNull(), F.col("data")))
    rows = rows.withColumn("label", F.nullif(F.regexp_extract("last", FINAL, 1), F.lit("")))
    rows = rows.withColumn("value", F.nullif(F.regexp_extract("last", FINAL, 2), F.lit("")))
    rows = rows.withColumn("token", F.try_element_at(F.split("value", "\\s+", 2), F.lit(1)))
    return rows.withColumn("final_lines", F.size("finals")).drop("finals", "last", "raw", "data")


def report_findings(parsed: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """key, columns to keep, ord, is_object, class_id, severity, confidence, file, line_ok of each finding; a value of another
    kind is null. Booleans pass as line numbers, fractions don't."""
    rows = parsed.select(*key, *(keep or []), F.posexplode(_items()).alias("ord", "item"))
    return rows.select(*key, *(keep or []), "ord", *_cells(F.col("item")))


def _items() -> Column:
    return F.try_variant_get(F.col("payload"), "$.findings", "array<variant>")


def _cells(item: Column) -> list[Column]:
    """What a finding holds: is_object, class_id, severity, confidence, file, line_ok."""
    names = {"class_id": "class", "severity": "severity", "confidence": "confidence", "file": "file"}
    return [
        F.coalesce(kind(item) == "OBJECT", F.lit(False)).alias("is_object"),
        *[as_text(field(item, json)).alias(name) for name, json in names.items()],
        F.coalesce(F.schema_of_variant(field(item, "line")).isin("BIGINT", "BOOLEAN"), F.lit(False)).alias("line_ok"),
    ]


def _first(*pairs: tuple[Column, Column | str]) -> Column:
    """The message of the first condition that holds."""
    out = None
    for when, message in pairs:
        text = F.lit(message) if isinstance(message, str) else message
        out = F.when(when, text) if out is None else out.when(when, text)
    return out


def _judged(findings: DataFrame, classes: DataFrame) -> DataFrame:
    """findings (with mode and changed_files) with problems, an array.

    classes is the policy's table, 41 rows."""
    rows = findings.join(F.broadcast(classes.select("class_id", "tier")), "class_id", "left")
    return rows.withColumn("problems", _problems(F.col))


def _problems(of: Callable[[str], Column]) -> Column:
    """What is wrong with a finding; of gives its class's tier and what it holds, by name. mode and changed_files are columns."""
    known = of("tier").isNotNull()
    severity = F.concat(F.lit("advisory class "), of("class_id"), F.lit(" rated "), of("severity"), F.lit(", ceiling is LOW"))
    is_in = lambda c, values: F.coalesce(of(c).isin(values), F.lit(False))
    found = F.array(
        _first(
            (of("class_id").isNull(), "finding class must be a string"),
            (~known, F.concat(F.lit("unknown class "), of("class_id"))),
        ),
        _first(
            (~is_in("severity", SEVERITIES), "finding severity must be one of " + ", ".join(SEVERITIES)),
            (known & (of("tier") == "Advisory") & (of("severity") != "LOW"), severity),
        ),
        _first((~is_in("confidence", CONFIDENCES), "finding confidence must be certain or likely")),
        _first((~of("line_ok"), "finding line must be an integer")),
        _first(
            (of("file").isNull(), "finding file must be a string"),
            (
                (F.col("mode") == "PR") & ~F.array_contains("changed_files", of("file")),
                F.concat(F.lit("finding cites "), of("file"), F.lit(" outside the changed files")),
            ),
        ),
    )
    return F.when(~of("is_object"), F.array(F.lit("finding must be a JSON object"))).otherwise(F.array_compact(found))


def _rank(of: Callable[[str], Column] = F.col) -> Column:
    """What the tier of a finding's class asks for."""
    high = (of("tier") == "Graded") & F.coalesce(of("severity") == "HIGH", F.lit(False))
    return F.when((of("tier") == "Blocking") | high, 2).when(of("tier") == "Escalate", 1).otherwise(0)


def _judged_in_row(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """parsed (with mode and changed_files) with required, the highest rank of its findings, and middle, their problems in order: a report's findings
    stay in its row, so that it is parsed once and nothing is dealt or joined back."""
    each = classes.filter("class_id is not null").groupBy("class_id").agg(F.max("tier").alias("tier"))
    tiers = each.agg(F.map_from_entries(F.collect_list(F.struct("class_id", "tier"))).alias("tiers"))
    cells = F.transform(_items(), lambda item: F.struct(*_cells(item)))
    tiered = F.transform(cells, lambda c: F.struct(c.alias("c"), F.try_element_at(F.col("tiers"), c["class_id"]).alias("tier")))

    def judged(x: Column) -> Column:
        of = lambda name: x["tier"] if name == "tier" else x["c"][name]
        return F.struct(F.when(x["tier"].isNotNull(), _rank(of)).alias("rank"), _problems(of).alias("problems"))

    rows = parsed.crossJoin(F.broadcast(tiers)).withColumn("judged", F.transform(tiered, judged))
    rows = rows.withColumn("required", F.coalesce(F.array_max("judged.rank"), F.lit(0))).withColumn("middle", F.flatten("judged.problems"))
    return rows.drop("judged", "tiers")


def finding_problems(findings: DataFrame, classes: DataFrame, envelopes: DataFrame, key: list[str]) -> DataFrame:
    """key, ord, n, problem: what is wrong with each finding; an envelope's files are looked up in its array."""
    rows = _judged(findings.join(envelopes.select(*key, "mode", "changed_files"), key), classes)
    return rows.select(*key, "ord", F.posexplode("problems").alias("n", "problem"))


def required_verdict(findings: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """key, required: the rank that the tiers ask for; a maximum, so it is summed up before the shuffle."""
    rows = findings.join(F.broadcast(classes.select("class_id", "tier")), "class_id")
    return rows.groupBy(*key).agg(F.max(_rank()).alias("required"))


def verdict_problem(token: Column, required: Column, unreviewed: Column) -> Column:
    """Array of problems of a stated verdict; NEEDS-HUMAN may stand where APPROVE would do."""
    stated = verdict_rank(token)
    name = verdict_name(required)
    conflict = F.concat(F.lit("verdict "), token, F.lit(" conflicts with tiers, expected "), F.when(required == 0, "APPROVE or NEEDS-HUMAN").otherwise(name))
    wrong = ((required > 0) & (stated != required)) | ((required == 0) & (stated == 2))
    known = F.array_compact(F.array(F.when(wrong, conflict), F.when((F.size(unreviewed) > 0) & (stated == 0), "unreviewed files forbid APPROVE")))
    return F.when(stated.isNull(), F.array(F.concat(F.lit("unknown verdict token "), token))).otherwise(known)


def prescan_problem(payload: Column, ids: Column) -> Column:
    """Array of problems of the resolutions: malformed entries, then ids without one, sorted."""
    given = field(payload, "prescan")
    entries = F.coalesce(F.try_variant_get(given, "$", "array<variant>"), F.array().cast("array<variant>"))

    def usable(x: Column) -> Column:
        reason = field(x, "reason")
        said = F.when(kind(reason).isin("OBJECT", "ARRAY"), ~F.schema_of_variant(reason).isin("OBJECT<>", "ARRAY<VOID>")).otherwise(
            ~F.coalesce(F.try_variant_get(reason, "$", "string"), F.lit("")).isin("", "0", "0.0", "false")
        )
        status = F.coalesce(as_text(field(x, "status")).isin(STATUSES), F.lit(False))
        return F.coalesce((kind(x) == "OBJECT") & as_text(field(x, "id")).isNotNull() & status & said, F.lit(False))

    def told(done: Column) -> Column:
        """done: the ids of usable entries, null for others."""
        bad = F.transform(F.filter(done, lambda i: i.isNull()), lambda i: F.lit("prescan entries need an id, a confirmed or dismissed status, and a reason"))
        left = F.array_sort(F.array_except(ids, F.array_compact(done)))
        return F.concat(bad, F.transform(left, lambda i: F.concat(F.lit("prescan item "), i, F.lit(" lacks a resolution"))))

    # Each entry is looked at once, whatever names the result.
    done = F.transform(entries, lambda x: F.when(usable(x), as_text(field(x, "id"))))
    resolved = F.element_at(F.transform(F.array(done), told), 1)
    wrong = given.isNotNull() & (kind(given) != "ARRAY")
    return F.when(wrong, F.array(F.lit("VERDICT_JSON prescan must be an array"))).otherwise(resolved)


def validate_reports(reports: DataFrame, envelopes: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """key, token, problems: every problem of each report, in order; none means that it is valid."""
    parsed = parse_reports(reports).join(envelopes, key)
    payload = F.col("payload")
    rows = _judged_in_row(parsed, classes)
    pr = F.col("mode") == "PR"
    final = pr & ((F.coalesce(F.col("label"), F.lit("")) != "VERDICT") | (F.col("final_lines") != 1))
    has = payload.isNotNull()
    listed = F.coalesce(kind(field(payload, "findings")) == "ARRAY", F.lit(False))
    version = F.coalesce(as_text(field(payload, "schema_version")) == SCHEMA_VERSION, F.lit(False))
    said = field(payload, "verdict")
    same = as_text(said).eqNullSafe(F.col("token")) & (as_text(said).isNotNull() | said.isNull())
    shown = F.coalesce(F.try_variant_get(said, "$", "string"), F.lit("None"))
    head = F.array_compact(
        F.array(
            F.when(process_narration(F.col("text")), "report contains process narration"),
            F.when(final, F.concat(F.lit("expected exactly one final VERDICT line, found "), F.col("final_lines").cast("string"))),
            F.when(~has, F.col("json_error")),
            F.when(has & ~version, f"VERDICT_JSON schema_version must be '{SCHEMA_VERSION}'"),
            F.when(has & ~same, F.concat(F.lit("VERDICT_JSON verdict '"), shown, F.lit("' differs from final line '"), F.coalesce("token", F.lit("None")), F.lit("'"))),
            F.when(has & ~listed, "VERDICT_JSON findings must be an array"),
        )
    )
    none = F.array().cast(_NONE)
    verdicts = F.when(pr & F.col("token").isNotNull(), verdict_problem(F.col("token"), F.col("required"), F.col("unreviewed"))).otherwise(none)
    tail = F.when(has & listed, F.concat(verdicts, prescan_problem(payload, F.col("prescan_ids")))).otherwise(none)
    return rows.select(*key, "token", F.concat(head, F.coalesce("middle", none), tail).alias("problems"))


def problem_rows(validated: DataFrame, key: list[str]) -> DataFrame:
    return validated.select(*key, F.posexplode("problems").alias("n", "problem"))


