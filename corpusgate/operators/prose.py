"""Prose findings: spans of texts by category, the deny list, and cheap counts over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import prosetext
from corpusgate.functions.ship import ship
from corpusgate.functions.text import column_of, line_of

EXEMPT = "handoff-exempt"
SCOPES = ["global", EXEMPT]
#: Entries of a deny list that go out with one pass: some 50 MB of a worker.
ENTRIES = 200_000
#: Texts that become Python objects at a time, with their spans.
TEXTS = 200
#: The path of the notes for the next worker, and the deny list of the rules, by scope.
HANDOFF = "plan/HANDOFF.md.example"
DENYLIST = """[global]
worth noting
worst
serious
testament
serves as
stands as
functions as
utilize

[handoff-exempt]
this session
a round
could not carry
denied outright
Denied:
the user"""
TYPE_PREFIX = "^(?:feat|fix|chore|docs|test|ci):\\s+"
_OCCURRENCES = "array<struct<line:int,start:int,end:int>>"
_KIND = "array<struct<start:int,end:int,category:string,detail:string>>"


def load_denylist(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, entry, scope, line, error from rows key, line, line_text: sections in brackets, an entry to a line.

    Each key has a list of its own; without one, all lines are one list.

    Errors: an unknown scope, an entry before any, an entry that repeats another whatever its case."""
    rows = lines.withColumn("value", F.trim("line_text")).filter("value <> ''")
    named = F.regexp_extract("value", "^\\[(.*)\\]$", 1)
    rows = rows.withColumn("section", F.when(F.col("value").rlike("^\\[.*\\]$"), named))
    # A deny list has a few lines, so one task orders those of a key.
    key = key or []
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.last("section", ignorenulls=True).over(before))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*key, F.lower("value"), F.col("section").isNull()).orderBy("line")))
    error = (
        F.when(F.col("section").isNotNull() & ~F.col("section").isin(SCOPES), "unknown denylist scope")
        .when(F.col("section").isNull() & F.col("scope").isNull(), "denylist entry lacks a scope")
        .when(F.col("section").isNull() & (F.col("turn") > 1), "duplicate denylist entry")
    )
    rows = rows.withColumn("error", error).filter("section is null or error is not null")
    return rows.select(*key, F.col("value").alias("entry"), "scope", "line", "error")


def default_denylist() -> list[tuple[str, str, int]]:
    """entry, scope, line of DENYLIST."""
    scope, out = "", []
    for line, value in enumerate(DENYLIST.splitlines(), 1):
        if value.startswith("["):
            scope = value[1:-1]
        elif value:
            out.append((value, scope, line))
    return out


def _few(batches: Iterator[pa.RecordBatch], most: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows: what a worker holds in Python objects doesn't depend on how many rows Spark sends at once."""
    for batch in batches:
        yield from (batch.slice(i, most) for i in range(0, batch.num_rows, most))


def prose_spans(docs: DataFrame, key: list[str], deny: list[tuple[str, str, int]] | DataFrame | None = None, path: str | None = None, most: int = ENTRIES, rules: bool = True) -> DataFrame:
    """key, text, spans. deny: entries, scopes and lines, or such a table (entry, scope, line, as `load_denylist` gives it; rows with an error don't count).

    A table's entries are taken by line, then entry; an earlier one has priority. They go out with the function, `most` of them at a time: more take
    more passes over a row, whose occurrences are kept in the row until all are known, and only then overlaps are settled and the other rules read.
    path: a column; on the handoff path, exempt entries and the provenance rule don't hold. rules: False leaves the deny list alone."""
    spark = docs.sparkSession
    ship(spark)
    handoff = F.coalesce(F.col(path) == HANDOFF, F.lit(False)) if path else F.lit(False)
    none = F.array().cast(_OCCURRENCES)
    rows = docs.select(*key, F.coalesce(F.col("text"), F.lit("")).alias("text"), handoff.alias("handoff"), none.alias("denied"))
    n = len(key)
    names = rows.columns[: n + 2]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: n + 2])

    def finder(entries: list[tuple[str, str, int]]):
        """A function that adds the occurrences of these entries to those that a row has."""
        sent = spark.sparkContext.broadcast(tuple(entries))

        def found(batch: pa.RecordBatch) -> Iterator[tuple[str, bool, list[tuple[int, int, int]]]]:
            every = prosetext.denylist(tuple((e, line) for e, _, line in sent.value))
            some = tuple((e, line) for e, scope, line in sent.value if scope != EXEMPT)
            for text, note, held in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                listed = prosetext.denylist(some) if note else every
                yield text, note, [(d["line"], d["start"], d["end"]) for d in held] + [(listed.entries[i][1], a, b) for i, a, b in listed.matches(text)]

        return found

    def searched(found):
        """A pass that keeps what is found."""
        kind = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _few(batches):
                out = [[{"line": line, "start": a, "end": b} for line, a, b in denied] for _, _, denied in found(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(out, kind)], [*names, "denied"])

        return added

    # The last entries are looked for in the pass that settles overlaps, so a short list costs one pass and one worker.
    parts = _entries(deny, most)
    last = next(parts, [])
    for part in parts:
        rows = rows.mapInArrow(searched(finder(last)), f"{kinds}, denied {_OCCURRENCES}")
        last = part
    found_last = finder(last)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("detail", pa.string())]))
        for batch in _few(batches):
            out = []
            for text, note, denied in found_last(batch):
                found = prosetext.spans_beside(text, denied, note, rules)
                out.append([{"start": a, "end": b, "category": c, "detail": d} for a, b, c, d in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(out, kind)], [*names[: n + 1], "spans"])

    return rows.mapInArrow(scanned, f"{kinds.rpartition(', ')[0]}, spans {_KIND}")


def _entries(deny: list[tuple[str, str, int]] | DataFrame | None, most: int) -> Iterator[list[tuple[str, str, int]]]:
    """The entries in order, `most` at a time; of a table, one part is fetched after the other."""
    if not isinstance(deny, DataFrame):
        listed = default_denylist() if deny is None else deny
        yield from (listed[i : i + most] for i in range(0, len(listed), most))
        return
    good = (deny.filter("error is null") if "error" in deny.columns else deny).select("entry", "scope", "line").distinct()
    last = None
    while True:
        beyond = good if last is None else good.filter((F.col("line") > last[2]) | ((F.col("line") == last[2]) & ((F.col("entry") > last[0]) | ((F.col("entry") == last[0]) & (F.col("scope") > last[1])))))
        part = [(r.entry, r.scope, r.line) for r in beyond.orderBy("line", "entry", "scope").limit(most).collect()]
        if part:
            yield part
            last = part[-1]
        if len(part) < most:
            return


def prose_findings(docs: DataFrame, key: list[str], **settings) -> DataFrame:
    """key, line, column, category, detail, start, end of each span."""
    rows = prose_spans(docs, key, **settings).select(*key, "text", F.explode("spans").alias("s"))
    start = F.col("s.start")
    return rows.select(
        *key, line_of(F.col("text"), start).alias("line"), column_of(F.col("text"), start).alias("column"), "s.category", "s.detail", "s.start", "s.end"
    )


def message_prose(commits: DataFrame) -> DataFrame:
    """repo, sha, part and the spans of subjects (their type blank, places kept) and bodies."""
    prefix = F.regexp_extract("subject", TYPE_PREFIX, 0)
    subject = F.concat(F.repeat(F.lit(" "), F.char_length(prefix)), F.substr("subject", F.char_length(prefix) + 1))
    # A number of partitions that is given isn't cut down: messages are short, but a task's time is that of the rules on them.
    commits = commits.repartition(int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo", "sha")
    parts = F.array(F.struct(F.lit("subject").alias("part"), subject.alias("text")), F.struct(F.lit("body").alias("part"), F.col("body").alias("text")))
    rows = commits.select("repo", "sha", F.explode(parts).alias("p")).select("repo", "sha", "p.*")
    return prose_findings(rows, ["repo", "sha", "part"])


def mask_markdown_code(text: Column) -> Column:
    """The text with its fenced blocks and inline code blank, places and line feeds kept, as the prose rules read it."""
    # By lines, as a pattern that replaces each sign costs a match for each of them.
    blank = lambda part: F.array_join(F.transform(F.split(part, "\n", -1), lambda line: F.repeat(F.lit(" "), F.char_length(line))), "\n")
    outside = lambda part: F.array_join(F.transform(F.split(part, "`", -1), lambda x, i: F.when(i % 2 == 1, blank(x)).otherwise(x)), " ")
    blocks = F.regexp_extract_all(text, F.lit(prosetext.FENCED), F.lit(0))
    parts = F.zip_with(F.split(text, prosetext.FENCED, -1), blocks, lambda gap, block: F.concat(outside(gap), F.coalesce(blank(block), F.lit(""))))
    return F.when(text.rlike("`|~~~"), F.array_join(parts, "")).otherwise(text)


def prose_counts(docs: DataFrame, key: list[str], **settings) -> DataFrame:
    """key, category, texts and spans: how many texts have spans of each category, by all rules in their order and without overlaps."""
    categories = F.array_distinct(F.transform("spans", lambda s: s["category"]))
    counted = F.transform(categories, lambda c: F.struct(c.alias("category"), F.size(F.filter("spans", lambda s: s["category"] == c)).alias("n")))
    rows = prose_spans(docs, key, **settings).select(*key, F.explode(counted).alias("c"))
    return rows.groupBy(*key, F.col("c.category").alias("category")).agg(F.count(F.lit(1)).alias("texts"), F.sum("c.n").alias("spans"))


#: Of the rules, those whose matches a plain pattern counts alike in every engine.
COUNTED = {
    "comma_tail": ",\\s*(?:so|which)(?:[^A-Za-z0-9_]|$)",
    "hedging": "(?:^|[^A-Za-z])(?:could potentially|in some cases|might potentially|should probably|worth checking)(?:[^A-Za-z]|$)",
    "history": "(?:^|[^A-Za-z])(?:changed from|previously was|removed the old|replaced the old|used to)(?:[^A-Za-z]|$)",
    "contrast": "(?:^|[^A-Za-z0-9_])not\\s+(?:only|just|merely)(?:[^A-Za-z0-9_]|$)",
    "was_by": "(?:^|[^A-Za-z0-9_])(?:is|are|was|were)\\s+[a-z]+ed(?:[^A-Za-z0-9_]|$)",
}

#: What a text must contain for a match of the pattern, one of these; looking for plain words costs far less than trying the pattern at each place.
NEEDED = {
    "comma_tail": ["so", "which"],
    "hedging": ["could potentially", "in some cases", "might potentially", "should probably", "worth checking"],
    "history": ["changed from", "previously was", "removed the old", "replaced the old", "used to"],
    "contrast": ["only", "just", "merely"],
    "was_by": ["ed"],
}


def _counted(name: str) -> Column:
    """Matches of a pattern of COUNTED in a text, null for null."""
    needed = [F.contains(F.col("text"), F.lit(word)) for word in NEEDED[name]]
    found = needed[0]
    for one in needed[1:]:
        found = found | one
    return F.when(~found, 0).otherwise(F.regexp_count("text", F.lit(COUNTED[name]))).cast("bigint")


def prose_category_counts(docs: DataFrame, key: list[str]) -> DataFrame:
    """key and a count for each of COUNTED, without the rule on overlaps: one narrow pass and a small aggregation."""
    counts = [F.sum(_counted(name)).alias(name) for name in COUNTED]
    return docs.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), *counts)


def locate(text: Column, start: Column) -> Column:
    """struct<line, column> of a place."""
    return F.struct(line_of(text, start).alias("line"), column_of(text, start).alias("column"))
