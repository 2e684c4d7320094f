"""Verdicts: reviewing envelopes with a given function, merging chunks into one verdict, the gate, and what is shown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusgate.functions.ship import ship
from corpusgate.operators.reports import validate_reports, verdict_name, verdict_rank

MOST_ITEMS = 50
MOST_CHARS = 300
RETRY = "The previous report failed validation. Emit a corrected full report."


def cap_items(items: Column, most: int = MOST_ITEMS, chars: int = MOST_CHARS) -> Column:
    """At most so many items of so many characters; control characters become ?."""
    return F.transform(F.slice(items, 1, most), lambda x: F.substring(F.regexp_replace(x, "[\\x00-\\x1F\\x7F]", "?"), 1, chars))


def listed(items: Column, most: int = MOST_ITEMS) -> Column:
    """The capped items, and how many more there are."""
    more = F.concat(F.lit("... and "), (F.size(items) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(items) > most, F.concat(cap_items(items, most), F.array(more))).otherwise(cap_items(items, most))


def fence(text: Column) -> Column:
    """The text inside of a fence that is longer than any run of back-ticks in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`{3,}"), F.lit(0)), F.length))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest + 1, F.lit(3))))
    return F.concat(mark, F.lit("text\n"), F.regexp_replace(text, "(?U)\\s+$", ""), F.lit("\n"), mark)


def with_retry_note(envelope: str, problems: list[str]) -> str:
    data = json.loads(envelope)
    data["TRUSTED_CONTEXT"]["RETRY"] = {"note": RETRY, "problems": problems}
    return json.dumps(data, ensure_ascii=False)


def call_model(envelopes: DataFrame, model: Callable[[str, str, str], str], prompt: str, key: list[str]) -> DataFrame:
    """key, text, error: what model(prompt, mode, envelope) gives for each row's mode and envelope.

    A call that fails gives its error instead of failing the task."""
    ship(envelopes.sparkSession)
    rows = envelopes.select(*key, "mode", "envelope")
    n = len(key)

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for mode, envelope in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                try:
                    text, error = model(prompt, mode, envelope), None
                except Exception as problem:  # the caller's function may raise anything, and the row keeps it
                    text, error = None, f"model call failed: {problem}"
                texts.append(text)
                errors.append(error)
            columns = [batch.column(i) for i in range(n)] + [pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*key, "text", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(called, f"{kinds}, text string, error string")


@F.pandas_udf(StringType())
def _noted(envelopes, problems):
    return envelopes.combine(problems, lambda e, p: with_retry_note(e, list(p)))


def review_envelopes(
    envelopes: DataFrame,
    contexts: DataFrame,
    classes: DataFrame,
    model: Callable[[str, str, str], str],
    prompt: str,
    key: list[str],
    written: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """key, verdict, report, problems: a call for each envelope and one more, with a note, where the report is invalid.

    A failed call, or a second invalid report, is NEEDS-HUMAN without a report. `written` stores each round's answers
    (and reads them again), so that no retry of a task calls the model twice."""
    ship(envelopes.sparkSession)
    none = F.array().cast("array<string>")

    def answered(rows: DataFrame, name: str) -> DataFrame:
        got = written(call_model(rows, model, prompt, key), name)
        checked = validate_reports(got.filter("error is null").select(*key, "text"), contexts, classes, key)
        rows = got.join(checked, key, "left")
        problems = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.coalesce("problems", none))
        return written(rows.withColumn("problems", problems), f"{name}-checked")

    first = answered(envelopes, "review-1")
    again = first.filter("error is null and size(problems) > 0").select(*key, "problems").join(envelopes, key)
    again = again.withColumn("envelope", _noted(F.col("envelope"), cap_items(F.col("problems"))))
    second = answered(again.select(*key, "mode", "envelope"), "review-2")
    final = first.filter("error is not null or size(problems) = 0").unionByName(second)
    good = F.size("problems") == 0
    verdict = F.when(good, F.coalesce("token", F.lit("NEEDS-HUMAN"))).otherwise("NEEDS-HUMAN")
    return final.select(*key, verdict.alias("verdict"), F.when(good, F.col("text")).otherwise("").alias("report"), "problems")


def merge_verdicts(prs: DataFrame, chunks: DataFrame, findings: DataFrame, unreviewed: DataFrame, key: list[str]) -> DataFrame:
    """key, verdict: the worst of the chunks', BLOCK for a blocking finding, NEEDS-HUMAN for files or sets that weren't reviewed."""
    rank = lambda rows, value: rows.select(*key, F.lit(value).alias("rank"))
    ranks = chunks.select(*key, verdict_rank(F.col("verdict")).cast("int").alias("rank"))
    ranks = ranks.unionByName(rank(findings.filter("blocking"), 2)).unionByName(rank(unreviewed, 1))
    worst = ranks.groupBy(*key).agg(F.max("rank").alias("rank"))
    reviewed = chunks.select(*key).distinct().withColumn("reviewed", F.lit(True))
    rows = prs.select(*key).join(worst, key, "left").join(reviewed, key, "left")
    least = F.when(F.col("reviewed").isNull(), 1).otherwise(0)
    return rows.select(*key, verdict_name(F.greatest(F.coalesce("rank", F.lit(0)), least)).alias("verdict"))


def gate(verdicts: DataFrame, fail_on_block: bool = True) -> DataFrame:
    return verdicts.withColumn("fails", F.lit(fail_on_block) & F.col("verdict").isin("BLOCK", "NEEDS-HUMAN"))


def result_table(verdicts: DataFrame, chunks: DataFrame, findings: DataFrame, unreviewed: DataFrame, key: list[str]) -> DataFrame:
    """key, verdict, blocking_prescan, unreviewed (paths, sorted), chunks (structs in order)."""
    blocking = findings.groupBy(*key).agg(F.count_if("blocking").alias("blocking_prescan"))
    files = unreviewed.groupBy(*key).agg(F.array_sort(F.collect_set("path")).alias("unreviewed"))
    parts = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "verdict", F.size("problems").alias("problems")))).alias("chunks"))
    rows = verdicts.join(blocking, key, "left").join(files, key, "left").join(parts, key, "left")
    return rows.withColumn("blocking_prescan", F.coalesce("blocking_prescan", F.lit(0))).withColumn(
        "unreviewed", F.coalesce("unreviewed", F.array().cast("array<string>"))
    )


def render_report(
    results: DataFrame, chunks: DataFrame, findings: DataFrame, key: list[str], title: str = "Quality review", marker: str | None = None, run_url: str | None = None
) -> DataFrame:
    """key, report: the comment on a change set, as markdown. Text from outside is fenced.

    results: key, verdict, base_sha, head_sha, unreviewed (paths). chunks: key, chunk, verdict, problems, report. findings: key, id, path, line, class_id,
    message, blocking; of the blocking ones the first are shown, by the number of their id, and how many more there are. marker: a first line by which
    the comment is found again; run_url: a column's name in results, a link to the run."""
    heading = lambda text: F.concat(F.lit("\n### "), text, F.lit("\n\n"))
    by_id = Window.partitionBy(*key).orderBy(F.substring("id", 2, 12).cast("int"), "path", "line")
    item = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "class_id", F.lit(": "), "message")
    blocking = findings.filter("blocking").withColumn("n", F.row_number().over(by_id))
    first = blocking.filter(F.col("n") <= MOST_ITEMS).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))).alias("first"))
    first = first.join(findings.filter("blocking").groupBy(*key).agg(F.count(F.lit(1)).alias("held")), key)
    more = F.when(F.col("held") > MOST_ITEMS, F.array(F.concat(F.lit("... and "), (F.col("held") - MOST_ITEMS).cast("string"), F.lit(" more"))))
    shown = F.concat(cap_items(F.transform("first", lambda x: x["item"])), F.coalesce(more, F.array().cast("array<string>")))
    parts = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "verdict", "problems", "report"))).alias("parts"))

    def part(c: Column) -> Column:
        told = F.transform(c["problems"], lambda p: F.concat(F.lit("Validation: "), p))
        problems = F.when(F.size(c["problems"]) > 0, F.concat(F.lit("Validation problems:\n\n"), fence(F.array_join(listed(told), "\n")), F.lit("\n")))
        report = F.when(c["report"] != "", F.concat(F.lit("\n"), fence(c["report"]), F.lit("\n")))
        none = F.lit("")
        return F.concat(heading(F.concat(F.lit("Chunk "), c["chunk"].cast("string"), F.lit(": "), c["verdict"])), F.coalesce(problems, none), F.coalesce(report, none))

    rows = results.join(first, key, "left").join(parts, key, "left")
    found = F.when(F.col("held") > 0, F.concat(heading(F.lit("Blocking prescan findings")), fence(F.array_join(shown, "\n")), F.lit("\n")))
    files = F.when(F.size("unreviewed") > 0, F.concat(heading(F.lit("Unreviewed files")), fence(F.array_join(listed(F.col("unreviewed")), "\n")), F.lit("\n")))
    reviewed = F.array_join(F.transform("parts", part), "")
    head = F.concat(F.lit(f"{marker}\n" if marker else ""), F.lit(f"## {title}: "), "verdict", F.lit("\n\nBase `"), "base_sha", F.lit("`. Head `"), "head_sha", F.lit("`.\n"))
    run = F.concat(F.lit("Workflow run: "), F.col(run_url), F.lit("\n")) if run_url else F.lit("")
    return rows.select(*key, F.concat(head, *(F.coalesce(x, F.lit("")) for x in (run, found, files, reviewed))).alias("report"))
