"""Every query of the library's own operators, against DuckDB where it has an oracle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_rows
from corpusgate.jobs import queries as own

QUERIES, ORACLES = own.queries(), own.oracles()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same_rows(QUERIES[name](spark, str(DATA)), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_prose_of_every_language(spark, tmp_path):
    text = "This was changed from one to the other, which is not only slow."
    rows = [(1, text, "en", "a"), (2, text, "fr", "a"), (3, text, None, "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in QUERIES["w1_w3_prose_findings"](spark, str(tmp_path)).collect()} == {1, 2, 3}
    assert [(r.texts, r.history) for r in QUERIES["w2_prose_category_counts_all"](spark, str(tmp_path)).collect()] == [(3, 3)]


def test_prose_counts_by_brute_force(spark):
    from corpusgate.functions import prosetext
    from corpusgate.operators.prose import default_denylist

    deny, wanted = [(e, line) for e, _, line in default_denylist()], {}
    for source, text in spark.read.parquet(f"{DATA}/documents.parquet").select("source", "text").collect():
        of: dict = {}
        for _, _, category, _ in prosetext.spans(text or "", deny):
            of[category] = of.get(category, 0) + 1
        for category, n in of.items():
            texts, spans = wanted.get((source, category), (0, 0))
            wanted[source, category] = (texts + 1, spans + n)
    got = QUERIES["w2_prose_counts"](spark, str(DATA)).collect()
    assert {(r.source, r.category): (r.texts, r.spans) for r in got} == wanted


def test_message_prose_by_brute_force(spark):
    """Subjects, their type blank, and bodies, each on its own, by the rules on one text."""
    import re

    from corpusgate.functions import prosetext
    from corpusgate.operators import prose
    from corpusgate.sources.synth import view

    deny, wanted = [(e, line) for e, _, line in prose.default_denylist()], []
    commits = view(spark, str(DATA), "commits").limit(400).cache()
    for r in commits.collect():
        subject = re.sub(prose.TYPE_PREFIX, lambda m: " " * len(m[0]), r.subject)
        for part, text in (("subject", subject), ("body", r.body)):
            for start, end, category, detail in prosetext.spans(text, deny):
                wanted.append((r.repo, r.sha, part, text.count("\n", 0, start) + 1, start - text.rfind("\n", 0, start), category, detail, start, end))
    assert sorted(tuple(r) for r in prose.message_prose(commits).collect()) == sorted(wanted)
    assert wanted


def test_messages_are_dealt_to_every_partition(spark):
    """Small rows with long work: Spark isn't left to put them into few tasks."""
    from corpusgate.operators import prose

    rows = spark.range(500).selectExpr("'r' AS repo", "md5(CAST(id AS STRING)) AS sha", "'fix: it was made' AS subject", "'b' AS body").groupBy("repo", "sha", "subject", "body").count()
    assert len(prose.message_prose(rows).select(F.spark_partition_id()).distinct().collect()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_code_is_blanked_without_a_match_for_each_sign(spark):
    from corpusgate.functions import prosetext
    from corpusgate.operators import prose

    texts = ["a `b\nc \U0001f600` d", "x\n```\n\n e \r\n\u2028f\n```\n`g", "```\n\n", "``", "`\n\n`\n", "no code"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", prose.mask_markdown_code(F.col("text")).alias("t"))
    assert {r.n: r.t for r in rows.collect()} == {i: prosetext.masked(t) for i, t in enumerate(texts)}
    assert "[^\n]" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_masked_texts_are_built_once(spark):
    """A step that is named several times is no part of what names it."""
    plan = QUERIES["w3_mask_markdown_code"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_envelopes_deal_patches_once(spark):
    """What the view numbers is written by change set, and patches, places and findings meet there in one shuffle; a join for each dealt them anew."""
    for name in ("p12_p13_envelopes", "p12_envelope_digests"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]
        assert len(wide) <= 2, wide


def test_reports_are_parsed_once(spark):
    """A report's findings are judged in its row; they aren't taken out of a second parse and joined back."""
    plan = QUERIES["r7_validate_reports"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and "Generate" not in plan


def test_lines_of_patches_need_no_pattern_for_each(spark):
    """A hunk's start is read once, and plain line feeds are no search; with odd ends, overflows and text before the first hunk it stays right."""
    import re

    from corpusgate.operators import diffs

    hunks = "@@ -1 +{} @@ x{e}+a{e} b{e}-c{e}+d{e}"
    texts = ["", "@@", "+x\n@@ -1 +5,2 @@", "\n\n@@ -1 +7 @@\n+", "+@@ -1 +3 @@\n+a", "@@ -1 +99999999999 @@\n+a\n b\n+c", None]
    texts += [before + "".join(hunks.format(n, e=e) for n in (4, 90)) for e in ("\n", "\r\n", "\r", "\u2028", "\x0b") for before in ("", "+q" + e)]
    ends = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

    def added(text):
        out, line = [], None
        for part in re.split(ends, text or ""):
            if head := re.match(diffs.HUNK, part):
                line = int(head[1]) if int(head[1]) < 2**31 else 0
            elif line is not None and part[:1] in ("+", " ") and part:
                out += [line] if part[0] == "+" else []
                line += 1
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, patch string").select("n", diffs.added_numbers(F.col("patch")).alias("at"))
    assert {r.n: r["at"] or [] for r in rows.collect()} == {i: added(t) for i, t in enumerate(texts)}
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_packing_by_ranges_of_high_order_keys(spark, tmp_path):
    """Places in the set of all line items go above an int from order 21,474,836 on: the same chunks, at places so much higher."""
    rows = [(k, n, float(1 + (k * 7 + n * 13) % 50)) for k in range(40) for n in range(k % 6)]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double")
    far, got = 359 * 150_000, []
    for name, shift in (("low", 0), ("high", far)):
        table.withColumn("l_orderkey", F.col("l_orderkey") + shift).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        packed = QUERIES["p8_pack_ranges"](spark, f"{tmp_path}/{name}")
        kinds = {packed.schema[c].dataType.simpleString() for c in ("first", "last")}
        assert kinds == {"bigint" if shift else "int"}
        got.append(sorted((r.pr if r.pr < 0 else r.pr - shift, r.chunk, r.files, r.bytes, *(p - (100 * shift if r.pr < 0 else 0) for p in (r.first, r.last))) for r in packed.select("pr", "chunk", "files", "bytes", F.col("first").alias("first"), "last").collect()))
    assert got[0] == got[1] and len(got[0]) > 40


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_needed_words_stand_in_every_match():
    from corpusgate.operators import prose

    assert set(prose.NEEDED) == set(prose.COUNTED)
    assert all(word in prose.COUNTED[name] for name, words in prose.NEEDED.items() for word in words)
