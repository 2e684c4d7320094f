"""Queries of reports, verdicts, policies and evaluation cases; orders taken as reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.operators import evalset, policy, reports, verdicts
from corpusgate.sources.synth import CLASSES, VIEWS, view, with_views

PR = ["pr"]


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reports")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "classes")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(F.lit("a.py"), F.lit("b.py"))
    unreviewed = F.when(F.col("pr") % 23 == 0, F.array(F.lit("big.bin"))).otherwise(F.array().cast("array<string>"))
    rows = _reports(spark, sf_dir)
    return rows.select("pr", "mode", files.alias("changed_files"), F.array(F.lit("P1")).alias("prescan_ids"), unreviewed.alias("unreviewed"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.parse_reports(_reports(spark, sf_dir))
    return rows.select("pr", "label", "value", "token", "final_lines", "json_error", F.col("payload").isNotNull().alias("has_payload"))


def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("pr", reports.process_narration(F.col("text")).alias("narration"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_findings(reports.parse_reports(_reports(spark, sf_dir)), PR)


def finding_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.finding_problems(_findings(spark, sf_dir), _classes(spark, sf_dir), _envelopes(spark, sf_dir), PR)
    return rows.select("pr", "ord", "problem")


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.required_verdict(_findings(spark, sf_dir), _classes(spark, sf_dir), PR)
    return rows.select("pr", reports.verdict_name(F.col("required")).alias("required"))


def verdict_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' stated verdicts against a required one by key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    token = F.when(F.col("o_orderkey") % 10 == 0, "MAYBE").otherwise(reports.verdict_name((F.col("o_custkey") % 3).cast("int")))
    unreviewed = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    problems = reports.verdict_problem(token, (F.col("o_orderkey") % 3).cast("int"), unreviewed)
    return orders.select("o_orderkey", F.explode(problems).alias("problem"))


def prescan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.lit("P2"), F.lit("P1"))
    rows = reports.parse_reports(_reports(spark, sf_dir)).filter("payload is not null")
    return rows.select("pr", F.explode(reports.prescan_problem(F.col("payload"), ids)).alias("problem"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.validate_reports(_reports(spark, sf_dir).select("pr", "text"), _envelopes(spark, sf_dir), _classes(spark, sf_dir), PR)
    return rows.select("pr", F.size("problems").cast("bigint").alias("n"), F.try_element_at("problems", F.lit(1)).alias("first"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "changes").filter("pr % 7 <> 3")
    verdict = F.when(F.col("ord") % 5 == 4, "BLOCK").when(F.col("ord") % 4 == 3, "NEEDS-HUMAN").otherwise("APPROVE")
    return lines.select("pr", F.col("ord").alias("chunk"), verdict.alias("verdict"), F.array().cast("array<string>").alias("problems"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    changes = view(spark, sf_dir, "changes")
    prs = changes.select("pr").distinct()
    found = changes.select("pr", (F.col("ord") == 6).alias("blocking"))
    return prs, _chunks(spark, sf_dir), found, changes.filter("not decodable").select("pr", "path")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.merge_verdicts(*_parts(spark, sf_dir), PR)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.gate(merged(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    prs, chunks, found, unreviewed = _parts(spark, sf_dir)
    rows = verdicts.result_table(verdicts.merge_verdicts(prs, chunks, found, unreviewed, PR), chunks, found, unreviewed, PR)
    return rows.select(
        "pr", "verdict", "blocking_prescan", F.array_join("unreviewed", ",").alias("unreviewed"), F.coalesce(F.size("chunks"), F.lit(-1)).cast("bigint").alias("chunks")
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each document, capped as items of a comment."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = F.split("text", "\n", -1)
    shown = verdicts.listed(items, 3)
    return docs.select("doc_id", F.array_join(shown, "|").alias("shown"), F.length(verdicts.fence(F.col("text"))).cast("bigint").alias("fenced"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment of each order: line items as chunks, with problems or a report that holds a fence, and as findings."""
    prs, chunks, found, unreviewed = _parts(spark, sf_dir)
    rows = verdicts.result_table(verdicts.merge_verdicts(prs, chunks, found, unreviewed, PR), chunks, found, unreviewed, PR)
    rows = rows.withColumn("base_sha", F.lit("b" * 40)).withColumn("head_sha", F.md5(F.col("pr").cast("string")))
    faulty = F.col("verdict") == "NEEDS-HUMAN"
    problems = F.when(faulty, F.array(F.lit("unknown class\tZ9"), F.concat(F.lit("chunk "), F.col("chunk").cast("string")))).otherwise(F.col("problems"))
    report = F.when(faulty, "").otherwise(F.concat(F.lit("```\ncode\n```\nVERDICT: "), "verdict", F.lit("\n\n")))
    told = chunks.withColumn("problems", problems).withColumn("report", report)
    items = view(spark, sf_dir, "changes").select(
        "pr", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), "path", F.col("ord").alias("line"), F.lit("M12").alias("class_id"), F.lit("marker").alias("message"), (F.col("ord") >= 4).alias("blocking")
    )
    return verdicts.render_report(rows, told, items, PR)


#: A policy for each nation: all classes but one by its key, with faults by its key.
VIEWS["policies"] = (
    "SELECT CAST(n_nationkey AS BIGINT) AS nation, '# Policy' || chr(10) || 'VERDICT: APPROVE | BLOCK | NEEDS-HUMAN' || chr(10) || 'RISK: RISK (partial): VERDICT_JSON: \"schema_version\"' || chr(10) || "
    + " || ".join(
        f"CASE WHEN n_nationkey % 45 = {i} THEN '' ELSE '### {c} ' || CASE WHEN n_nationkey % 3 = 1 AND {i} = 7 THEN 'Renamed' ELSE '{n}' END || ' (' || CASE WHEN n_nationkey % 4 = 2 AND {i} = 9 THEN 'Wrong' WHEN n_nationkey % 5 = 3 AND {i} = 11 THEN 'Escalate' ELSE '{t}' END || '{' +script' if s else ''})' || chr(10) END"
        for i, (c, n, t, s) in enumerate(CLASSES)
    )
    + " || CASE n_nationkey % 6 WHEN 0 THEN '### Q1 Again (Graded)' || chr(10) WHEN 1 THEN 'A dash - here' || chr(10) WHEN 2 THEN '```' || chr(10) || repeat('w', 130) || chr(10) || '```' || chr(10) || repeat('w', 121) || chr(10)"
    " WHEN 3 THEN '- item `a - b`' || chr(10) WHEN 4 THEN 'caf' || chr(233) || chr(13) || chr(10) ELSE '## Twice' || chr(10) || '## Twice' || chr(10) END AS text FROM {nation}"
)


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "policies")


def policy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.parse_classes(_policies(spark, sf_dir), ["nation"])


def policy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's policy against the table of classes."""
    head = policy_classes(spark, sf_dir)
    base = _policies(spark, sf_dir).select("nation").join(F.broadcast(_classes(spark, sf_dir)))
    return policy.compare_policies(base, head, ["nation"])


def cases_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _policies(spark, sf_dir).filter("nation % 2 = 0").select("nation", F.lit("eval/cases/x/expected.json").alias("path"))
    return policy.eval_case_required(policy_diff(spark, sf_dir), changed, ["nation"])


def _on_policies(rule):
    return lambda spark, sf_dir: rule(_policies(spark, sf_dir), ["nation"])


#: An evaluation case for each part: what its report should say.
VIEWS["eval_cases"] = """
SELECT p_partkey AS slug, CASE p_partkey % 4 WHEN 3 THEN 'File' ELSE 'PR' END AS mode,
  CASE p_partkey % 4 WHEN 3 THEN 'RISK: HIGH' WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'APPROVE' ELSE 'NEEDS-HUMAN' END AS expected_verdict,
  'Q' || CAST(1 + p_partkey % 14 AS STRING) AS class_a, 'M' || CAST(1 + p_partkey % 18 AS STRING) AS class_b, p_partkey % 6 <> 0 AS expect_json,
  p_partkey % 5 = 0 AS forbid_process_narration, CASE WHEN p_partkey % 9 = 0 THEN 'NEEDS-HUMAN' END AS expected_review_status, CAST(p_size * 30 AS INT) AS active_work_elapsed_seconds,
  CASE WHEN p_partkey % 10 = 0 THEN 'I think so.' || chr(10) ELSE '' END || CASE WHEN p_partkey % 18 = 0 THEN 'REVIEW STATUS: NEEDS-HUMAN' || chr(10) ELSE '' END
    || CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_partkey % 8 = 3 THEN 'RISK: HIGH, as seen' ELSE 'RISK: HIGHER' END WHEN 0 THEN 'VERDICT: BLOCK' ELSE 'VERDICT: APPROVE' END || chr(10)
    || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'VERDICT_JSON: {{"findings":[{{"class":"Q' || CAST(1 + p_partkey % 14 AS STRING) || '"}},{{"class":"M' || CAST(1 + (p_partkey - p_partkey % 3) % 18 AS STRING) || '"}},3]}}' END AS text
FROM {part}"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "eval_cases").withColumn("expected_classes", F.array("class_a", "class_b"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir)
    return evalset.evaluate_responses(rows.drop("text", "class_a", "class_b"), rows.select("slug", "text"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("slug", "mode", F.array_join("failures", "; ").alias("failures"), "passed")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.parse_reports(_cases(spark, sf_dir))
    return rows.select("slug", evalset.verdict_matches(*[F.col(c) for c in ("mode", "expected_verdict", "label", "value", "token")]).alias("matches"))


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as JSON, with faults by key."""
    rows = view(spark, sf_dir, "eval_cases")
    k = F.col("slug") % 10
    expected = F.when(k == 0, F.lit('{"mode": "PR"}')).when(k == 1, F.lit("no json")).otherwise(
        F.to_json(
            F.struct(
                F.when(k == 2, "Other").otherwise(F.col("mode")).alias("mode"),
                F.when(k == 3, "RISK: LOW").otherwise(F.col("expected_verdict")).alias("expected_verdict"),
                F.array("class_a", F.when(k == 4, "Z1").otherwise(F.col("class_b"))).alias("expected_classes"),
                "expect_json",
                F.when(k == 5, " ").otherwise("n").alias("notes"),
                F.when(k == 6, F.lit(-1)).otherwise(F.col("active_work_elapsed_seconds")).alias("active_work_elapsed_seconds"),
            )
        )
    )
    files = F.create_map(F.when(F.col("mode") == "PR", F.when(k == 7, "other.txt").otherwise("diff.patch")).otherwise("input.py"), F.lit("x"))
    cases = rows.select("slug", expected.alias("expected"), files.alias("files"))
    return evalset.validate_cases(cases, [c for c, *_ in CLASSES])


_K = "CAST(pr % 16 AS INT)"
_STATED = "regexp_extract(text, 'VERDICT: (\\S+)', 1)"
_FINAL = "regexp_extract(text, 'VERDICT: ([^\\n]*)', 1)"
_TIER = "(CASE WHEN tier = 'Blocking' OR (tier = 'Graded' AND severity = 'HIGH') THEN 2 WHEN tier = 'Escalate' THEN 1 ELSE 0 END)"
_ROWS = f"(SELECT pr, class_1 AS class_id, severity_1 AS severity, 0 AS ord, {_K} AS k FROM reports WHERE {_K} NOT IN (6, 7, 8, 11) UNION ALL SELECT pr, class_2, 'LOW', 1, {_K} FROM reports WHERE {_K} NOT IN (6, 7, 8, 11))"
_NAME = "['APPROVE', 'NEEDS-HUMAN', 'BLOCK']"
_HEADINGS = "(SELECT nation, line, t, regexp_extract(t, '^### ([QMCD][0-9]+) ', 1) AS class_id, regexp_extract(t, '^### ([QMCD][0-9]+) ([^()]+) \\(([A-Za-z]+)( \\+script)?\\)$', ['id', 'name', 'tier', 'script']) AS h FROM (SELECT nation, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM policies) WHERE regexp_matches(t, '^### [QMCD][0-9]+ '))"
_VALID = "h.tier IN ('Blocking', 'Escalate', 'Graded', 'Advisory')"
_PARSED = f"(SELECT nation, class_id, arg_max(trim(h.name), line) AS name, arg_max(h.tier, line) AS tier, arg_max(h.script <> '', line) AS has_script FROM {_HEADINGS} WHERE {_VALID} GROUP BY nation, class_id)"
_BASE = "(SELECT nation, c.* FROM policies, classes AS c)"
_DIFF = f"""(SELECT nation, class_id, unnest(list_filter([CASE WHEN h.tier IS NULL THEN {{'kind': 'removed', 'old': b.tier, 'new': NULL}} END, CASE WHEN b.tier IS NULL THEN {{'kind': 'added', 'old': NULL, 'new': h.tier}} END,
  CASE WHEN b.tier <> h.tier THEN {{'kind': 'tier', 'old': b.tier, 'new': h.tier}} END, CASE WHEN b.has_script <> h.has_script THEN {{'kind': 'script', 'old': CAST(b.has_script AS VARCHAR), 'new': CAST(h.has_script AS VARCHAR)}} END,
  CASE WHEN b.name <> h.name THEN {{'kind': 'renamed', 'old': b.name, 'new': h.name}} END], lambda x: x IS NOT NULL)) AS d FROM {_BASE} AS b FULL JOIN {_PARSED} AS h USING (nation, class_id))"""
_REQUIRED_IDS = "(SELECT nation, unnest([" + ", ".join(f"'{c}'" for c in policy.REQUIRED_CLASSES) + "]) AS class_id FROM policies)"
_VERDICT_ROWS = """(SELECT pr, CASE WHEN ord % 5 = 4 THEN 2 WHEN ord % 4 = 3 THEN 1 ELSE 0 END AS r FROM changes WHERE pr % 7 <> 3 UNION ALL SELECT pr, 2 FROM changes WHERE ord = 6
  UNION ALL SELECT pr, 1 FROM changes WHERE NOT decodable UNION ALL SELECT pr, 1 FROM changes WHERE pr % 7 = 3)"""
_MERGED = f"(SELECT pr, {_NAME}[max(r) + 1] AS verdict FROM {_VERDICT_ROWS} GROUP BY pr)"
_MATCH = """coalesce(CASE WHEN mode = 'PR' THEN expected_verdict = CASE slug % 4 WHEN 0 THEN 'BLOCK' ELSE 'APPROVE' END ELSE slug % 8 = 3 END, false)"""
_LISTS = """(SELECT *, [class_a, class_b] AS want, [class_a, 'M' || CAST(1 + (slug - slug % 3) % 18 AS VARCHAR)] AS got FROM eval_cases)"""
_FAILURES = f"""list_filter([CASE WHEN forbid_process_narration AND slug % 10 = 0 THEN 'report contains process narration' END,
  CASE WHEN NOT {_MATCH} THEN 'expected verdict ''' || expected_verdict || ''' in final line ''' || CASE slug % 4 WHEN 3 THEN CASE WHEN slug % 8 = 3 THEN 'RISK: HIGH, as seen' ELSE 'RISK: HIGHER' END WHEN 0 THEN 'VERDICT: BLOCK' ELSE 'VERDICT: APPROVE' END || '''' END,
  CASE WHEN expected_review_status IS NOT NULL AND slug % 18 <> 0 THEN 'missing expected review status ' || expected_review_status END,
  CASE WHEN expect_json AND slug % 7 = 0 THEN 'missing VERDICT_JSON line' END], lambda x: x IS NOT NULL)
  || CASE WHEN slug % 7 = 0 THEN [] ELSE list_transform(list_sort(list_filter(want, lambda c: NOT list_contains(got, c))), lambda c: 'missing expected class ' || c)
  || list_transform(list_sort(list_filter(got, lambda c: NOT list_contains(want, c))), lambda c: 'unexpected class ' || c) END"""
_PASSED = f"(SELECT slug, mode, class_a, class_b, len({_FAILURES}) = 0 AS passed FROM {_LISTS})"
_PER_FINDING = f"""(SELECT pr, flatten(list(problems ORDER BY ord)) AS found, max(r) AS required FROM (SELECT pr, ord, CASE WHEN tier IS NULL THEN NULL ELSE {_TIER} END AS r, list_filter([
  CASE WHEN tier IS NULL THEN 'unknown class ' || class_id END, CASE WHEN tier = 'Advisory' AND severity <> 'LOW' THEN 'advisory class ' || class_id || ' rated ' || severity || ', ceiling is LOW' END,
  CASE WHEN k = 14 AND ord = 0 THEN 'finding confidence must be certain or likely' END, CASE WHEN k = 13 AND ord = 0 THEN 'finding line must be an integer' END,
  CASE WHEN k = 12 AND ord = 0 THEN 'finding cites other.py outside the changed files' END], lambda x: x IS NOT NULL) AS problems FROM {_ROWS} LEFT JOIN classes USING (class_id)) GROUP BY pr)"""
_STATED_RANK = "CASE token WHEN 'APPROVE' THEN 0 WHEN 'NEEDS-HUMAN' THEN 1 ELSE 2 END"
_VALIDATED = f"""
SELECT pr, CAST(len(p) AS BIGINT) AS n, p[1] AS first FROM (SELECT pr, list_filter([
    CASE WHEN k = 2 THEN 'report contains process narration' END,
    CASE k WHEN 1 THEN 'expected exactly one final VERDICT line, found 2' WHEN 4 THEN 'expected exactly one final VERDICT line, found 0' END,
    CASE k WHEN 6 THEN 'missing VERDICT_JSON line' WHEN 7 THEN 'VERDICT_JSON is not valid JSON' WHEN 8 THEN 'VERDICT_JSON must be a JSON object' WHEN 9 THEN 'VERDICT_JSON schema_version must be ''1''' END,
    CASE WHEN k = 4 THEN 'VERDICT_JSON verdict ''' || regexp_extract(text, '"verdict":"([^"]*)"', 1) || ''' differs from final line ''None''' WHEN k = 10 AND token <> 'BLOCK' THEN 'VERDICT_JSON verdict ''BLOCK'' differs from final line ''' || token || '''' END,
    CASE WHEN k = 11 THEN 'VERDICT_JSON findings must be an array' END], lambda x: x IS NOT NULL) || coalesce(found, [])
  || CASE WHEN k IN (4, 6, 7, 8, 11) THEN [] ELSE list_filter([
    CASE WHEN (q > 0 AND s <> q) OR (q = 0 AND s = 2) THEN 'verdict ' || token || ' conflicts with tiers, expected ' || CASE WHEN q = 0 THEN 'APPROVE or NEEDS-HUMAN' ELSE {_NAME}[q + 1] END END,
    CASE WHEN pr % 23 = 0 AND s = 0 THEN 'unreviewed files forbid APPROVE' END], lambda x: x IS NOT NULL) END
  || CASE WHEN k = 15 THEN ['prescan item P1 lacks a resolution'] ELSE [] END AS p
  FROM (SELECT pr, text, {_K} AS k, {_STATED} AS token, found, coalesce(required, 0) AS q, {_STATED_RANK.replace('token', _STATED)} AS s FROM reports LEFT JOIN {_PER_FINDING} AS f USING (pr)))"""
_FIXTURE = """CASE WHEN k = 1 OR k = 2 OR (k <> 0 AND mode <> 'PR') THEN CASE WHEN mode = 'PR' THEN 'non-PR mode requires an input.<ext> file' END
  WHEN mode <> 'PR' OR k = 7 THEN 'PR mode requires diff.patch' END"""
_STRUCTURE = f"""
SELECT slug, CAST(unnest(range(len(p))) AS INT) AS n, unnest(p) AS problem FROM (SELECT slug, CASE k WHEN 0 THEN ['missing key ''expected_verdict''', 'missing key ''expected_classes''', 'missing key ''expect_json''', 'missing key ''notes''']
  WHEN 1 THEN ['unreadable case'] WHEN 2 THEN ['invalid mode ''Other'''] WHEN 3 THEN CASE WHEN mode = 'PR' THEN ['verdict ''RISK: LOW'' does not fit mode PR'] ELSE [] END
  WHEN 4 THEN ['unknown class ''Z1'''] WHEN 5 THEN ['notes must be a non-empty string'] WHEN 6 THEN ['active_work_elapsed_seconds must be a non-negative integer'] ELSE [] END
  || list_filter([{_FIXTURE}], lambda x: x IS NOT NULL) AS p FROM (SELECT slug, mode, slug % 10 AS k FROM eval_cases))"""
_NL = "chr(10)"
_RENDERED = f"""
SELECT pr, '## Quality review: ' || verdict || {_NL} || {_NL} || 'Base `' || repeat('b', 40) || '`. Head `' || md5(CAST(pr AS VARCHAR)) || '`.' || {_NL}
  || coalesce({_NL} || '### Blocking prescan findings' || {_NL} || {_NL} || '```text' || {_NL} || items || {_NL} || '```' || {_NL}, '')
  || coalesce({_NL} || '### Unreviewed files' || {_NL} || {_NL} || '```text' || {_NL} || files || {_NL} || '```' || {_NL}, '') || coalesce(parts, '') AS report
FROM {_MERGED} JOIN (SELECT pr, string_agg(path || ':' || ord || ' M12: marker', {_NL} ORDER BY ord) FILTER (ord >= 4) AS items,
  string_agg(DISTINCT path, {_NL} ORDER BY path) FILTER (NOT decodable) AS files,
  string_agg({_NL} || '### Chunk ' || ord || ': ' || CASE WHEN ord % 5 = 4 THEN 'BLOCK' WHEN ord % 4 = 3 THEN 'NEEDS-HUMAN' ELSE 'APPROVE' END || {_NL} || {_NL} || CASE WHEN ord % 5 <> 4 AND ord % 4 = 3
    THEN 'Validation problems:' || {_NL} || {_NL} || '```text' || {_NL} || 'Validation: unknown class?Z9' || {_NL} || 'Validation: chunk ' || ord || {_NL} || '```' || {_NL}
    ELSE {_NL} || '````text' || {_NL} || '```' || {_NL} || 'code' || {_NL} || '```' || {_NL} || 'VERDICT: ' || CASE WHEN ord % 5 = 4 THEN 'BLOCK' ELSE 'APPROVE' END || {_NL} || '````' || {_NL} END, '' ORDER BY ord)
    FILTER (pr % 7 <> 3) AS parts FROM changes GROUP BY pr) USING (pr)"""
QUERIES = {
    "r1_parse_reports": (
        parsed,
        with_views(
            f"""SELECT pr, CASE WHEN {_K} = 4 THEN CASE WHEN {_K} = 1 THEN 'RISK' END ELSE 'VERDICT' END AS label, nullif({_FINAL}, '') AS value, nullif({_STATED}, '') AS token,
              CAST(CASE {_K} WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS INT) AS final_lines,
              CASE {_K} WHEN 6 THEN 'missing VERDICT_JSON line' WHEN 7 THEN 'VERDICT_JSON is not valid JSON' WHEN 8 THEN 'VERDICT_JSON must be a JSON object' END AS json_error,
              {_K} NOT IN (6, 7, 8) AS has_payload FROM reports""",
            "reports",
        ),
    ),
    "r2_process_narration": (narration, with_views(f"SELECT pr, {_K} = 2 AS narration FROM reports", "reports")),
    "r3_finding_problems": (
        finding_problems,
        with_views(
            f"""SELECT pr, CAST(ord AS INT) AS ord, problem FROM (SELECT pr, ord, unnest(list_filter([CASE WHEN tier IS NULL THEN 'unknown class ' || class_id END,
              CASE WHEN tier = 'Advisory' AND severity <> 'LOW' THEN 'advisory class ' || class_id || ' rated ' || severity || ', ceiling is LOW' END,
              CASE WHEN k = 14 AND ord = 0 THEN 'finding confidence must be certain or likely' END, CASE WHEN k = 13 AND ord = 0 THEN 'finding line must be an integer' END,
              CASE WHEN k = 12 AND ord = 0 THEN 'finding cites other.py outside the changed files' END], lambda x: x IS NOT NULL)) AS problem FROM {_ROWS} LEFT JOIN classes USING (class_id))""",
            "reports", "classes",
        ),
    ),
    "r4_required_verdict": (required, with_views(f"SELECT pr, {_NAME}[max({_TIER}) + 1] AS required FROM {_ROWS} JOIN classes USING (class_id) GROUP BY pr", "reports", "classes")),
    "r5_verdict_problems": (
        verdict_problems,
        """SELECT o_orderkey, problem FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 10 = 0 THEN ['unknown verdict token MAYBE'] ELSE list_filter([
          CASE WHEN (q > 0 AND s <> q) OR (q = 0 AND s = 2) THEN 'verdict ' || ['APPROVE', 'NEEDS-HUMAN', 'BLOCK'][s + 1] || ' conflicts with tiers, expected ' || CASE WHEN q = 0 THEN 'APPROVE or NEEDS-HUMAN' ELSE ['APPROVE', 'NEEDS-HUMAN', 'BLOCK'][q + 1] END END,
          CASE WHEN o_orderkey % 4 = 0 AND s = 0 THEN 'unreviewed files forbid APPROVE' END], lambda x: x IS NOT NULL) END) AS problem FROM (SELECT o_orderkey, o_custkey % 3 AS s, o_orderkey % 3 AS q FROM orders))""",
    ),
    "r6_prescan_problems": (
        prescan_problems,
        with_views(
            f"SELECT pr, 'prescan item P2 lacks a resolution' AS problem FROM reports WHERE {_K} NOT IN (6, 7, 8) UNION ALL SELECT pr, 'prescan item P1 lacks a resolution' FROM reports WHERE {_K} = 15",
            "reports",
        ),
    ),
    "r7_validate_reports": (validated, with_views(_VALIDATED, "reports", "classes")),
    "r9_merge_verdicts": (merged, with_views(f"SELECT * FROM {_MERGED}", "changes")),
    "r10_gate": (gated, with_views(f"SELECT *, verdict <> 'APPROVE' AS fails FROM {_MERGED}", "changes")),
    "r11_result_table": (
        results,
        with_views(
            f"""SELECT pr, verdict, blocking_prescan, unreviewed, CASE WHEN pr % 7 = 3 THEN -1 ELSE chunks END AS chunks FROM {_MERGED} JOIN (SELECT pr, count(*) FILTER (ord = 6) AS blocking_prescan, count(*) AS chunks FROM changes GROUP BY pr) USING (pr)
            JOIN (SELECT pr, coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (NOT decodable), '') AS unreviewed FROM changes GROUP BY pr) USING (pr)""",
            "changes",
        ),
    ),
    "r12_cap_items": (
        listed,
        """SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, chr(10)), 1, 3), lambda x: substr(regexp_replace(x, '[\\x00-\\x1F\\x7F]', '?', 'g'), 1, 300)), '|')
          || CASE WHEN len(string_split(text, chr(10))) > 3 THEN '|... and ' || CAST(len(string_split(text, chr(10))) - 3 AS VARCHAR) || ' more' ELSE '' END AS shown,
          CAST(length(regexp_replace(text, '\\s+$', '')) + 12 AS BIGINT) AS fenced FROM documents""",
    ),
    "r12_render_report": (rendered, with_views(_RENDERED, "changes")),
    "c1_parse_classes": (policy_classes, with_views(f"SELECT * FROM {_PARSED}", "policies")),
    "c2_class_violations": (
        _on_policies(policy.class_violations),
        with_views(
            f"""SELECT nation, 'duplicate class: ' || class_id AS violation FROM (SELECT nation, class_id, row_number() OVER (PARTITION BY nation, class_id ORDER BY line) AS n FROM {_HEADINGS}) WHERE n > 1
            UNION ALL SELECT nation, 'class heading without a valid tier: ' || t FROM {_HEADINGS} WHERE NOT ({_VALID})
            UNION ALL SELECT nation, 'missing class: ' || class_id FROM {_REQUIRED_IDS} AS r WHERE NOT EXISTS (SELECT 1 FROM {_HEADINGS} AS h WHERE h.nation = r.nation AND h.class_id = r.class_id)""",
            "policies",
        ),
    ),
    "c3_structure_violations": (
        _on_policies(policy.structure_violations),
        with_views("SELECT nation, 'duplicate heading: ## Twice' AS violation FROM policies WHERE nation % 6 = 5", "policies"),
    ),
    "c4_line_violations": (
        _on_policies(policy.line_violations),
        with_views(
            """SELECT nation, 'line ' || CAST(len(string_split(text, chr(10))) - 1 AS VARCHAR) || CASE nation % 6 WHEN 1 THEN ' uses a prose dash' ELSE ' exceeds 120 characters' END AS violation
            FROM policies WHERE nation % 6 IN (1, 2)""",
            "policies",
        ),
    ),
    "c5_encoding_violations": (
        _on_policies(policy.encoding_violations),
        with_views(
            "SELECT nation, unnest(['policy must use LF line endings', 'policy must contain ASCII text only']) AS violation FROM policies WHERE nation % 6 = 4", "policies"
        ),
    ),
    "c6_compare_policies": (policy_diff, with_views(f"SELECT nation, class_id, d.kind AS kind, d.old AS old, d.new AS new FROM {_DIFF}", "policies", "classes")),
    "c7_eval_case_required": (
        cases_required,
        with_views(
            f"SELECT DISTINCT nation, 'class or tier changes need a changed evaluation case' AS violation FROM {_DIFF} WHERE d.kind <> 'renamed' AND nation % 2 = 1", "policies", "classes"
        ),
    ),
    "e1_validate_cases": (structure, with_views(_STRUCTURE, "eval_cases")),
    "e2_verdict_matches": (matches, with_views(f"SELECT slug, {_MATCH} AS matches FROM eval_cases", "eval_cases")),
    "e3_e4_evaluate_responses": (
        failures,
        with_views(f"SELECT slug, mode, array_to_string({_FAILURES}, '; ') AS failures, len({_FAILURES}) = 0 AS passed FROM {_LISTS}", "eval_cases"),
    ),
    "e5_pass_rate": (
        lambda spark, sf_dir: evalset.pass_rate(evaluated(spark, sf_dir)),
        with_views(
            f"""SELECT mode, class_id, count(DISTINCT slug) FILTER (passed) AS passed, count(DISTINCT slug) AS total FROM (SELECT slug, mode, passed, unnest([class_a, class_b]) AS class_id FROM {_PASSED})
            GROUP BY ROLLUP (mode, class_id)""",
            "eval_cases",
        ),
    ),
    "e6_timeout_status": (
        lambda spark, sf_dir: evalset.timeout_status(view(spark, sf_dir, "eval_cases").select("slug", "active_work_elapsed_seconds")),
        with_views("SELECT slug, active_work_elapsed_seconds, CASE WHEN active_work_elapsed_seconds >= 600 THEN 'NEEDS-HUMAN' END AS review_status FROM eval_cases", "eval_cases"),
    ),
}
