"""Deny lists: one automaton against a pattern for each entry, as a table, in several passes."""

from __future__ import annotations

import random

import pyarrow as pa

from corpusgate.functions import prosetext
from corpusgate.operators import prose

SIGNS = "aAbBkKKsSſı.-ß:  é"


def entry_by_entry(text, deny):
    return [(n, *m.span()) for n, (entry, _) in enumerate(deny) for m in prosetext.entry_pattern(entry).finditer(text)]


def made(rng, most=6):
    entries = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 5))).strip() for _ in range(rng.randint(0, most))]
    return tuple((e, i) for i, e in enumerate(entries, 1) if e)


def text_of(rng):
    return "".join(rng.choice(SIGNS + "aabb \n\t ") for _ in range(rng.randint(0, 40)))


def test_one_pass_finds_what_each_pattern_finds():
    rng = random.Random(11)
    for _ in range(150):
        deny = made(rng)
        entries = prosetext.Denylist(deny)
        for _ in range(20):
            text = text_of(rng)
            assert entries.matches(text) == entry_by_entry(text, deny), (deny, text)


def restated(text, deny):
    """Entries in order; what overlaps an earlier span is dropped."""
    out = []
    for _, a, b, line in sorted((n, a, b, deny[n][1]) for n, a, b in entry_by_entry(text, deny)):
        if all(b <= c or d <= a for c, d, _ in out):
            out.append((a, b, line))
    return sorted(out)


def test_table_of_entries_in_passes(spark):
    rng = random.Random(12)
    deny = made(rng, 40)
    texts = [text_of(rng) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string").repartition(3)
    entries = spark.createDataFrame([(e, "global", line, None) for e, line in deny] + [("aa", "nowhere", 0, "unknown denylist scope")], "entry string, scope string, line int, error string")
    unique = tuple(dict.fromkeys(deny))
    for most in (1000, 3):
        rows = prose.prose_spans(docs, ["doc_id"], entries, most=most, rules=False).collect()
        got = {r.doc_id: [(s.start, s.end, int(s.detail.removeprefix("denylist line "))) for s in r.spans] for r in rows}
        assert got == {i: restated(t or "", unique) for i, t in enumerate([*texts, None])}


def test_scopes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, prose.HANDOFF, "the user is worst"), (2, "a.md", "the user is worst")], "doc_id bigint, path string, text string")
    entries = spark.createDataFrame([(e, scope, line) for e, scope, line in prose.default_denylist()], "entry string, scope string, line int")
    rows = prose.prose_spans(docs, ["doc_id"], entries, path="path", rules=False).collect()
    assert {r.doc_id: [s.start for s in r.spans] for r in rows} == {1: [12], 2: [0, 12]}
    rows = prose.prose_spans(docs, ["doc_id"], entries.limit(0), path="path", rules=False).collect()
    assert all(r.spans == [] for r in rows) and len(rows) == 2


def test_many_entries_cost_one_pass(spark):
    entries = spark.range(100_000).selectExpr("concat('entry word', id, 'x') AS entry", "'global' AS scope", "CAST(id AS INT) AS line")
    docs = spark.createDataFrame([(1, " ".join(f"see Entry  WORD{i}x," for i in range(0, 100_000, 1000)))], "doc_id bigint, text string")
    spans = prose.prose_spans(docs, ["doc_id"], entries, rules=False).first().spans
    assert [s.detail for s in spans] == [f"denylist line {i}" for i in range(0, 100_000, 1000)]


def test_few_texts_are_held_at_a_time():
    """Batches of any length are read in parts of a few rows, in order."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["id"]) for n in (3000, 0, 1, prose.TEXTS)]
    parts = list(prose._few(iter(batches)))
    assert max(map(len, parts)) == prose.TEXTS
    assert [i for part in parts for i in part.column(0).to_pylist()] == [i for batch in batches for i in batch.column(0).to_pylist()]


def test_a_short_list_costs_one_pass(spark):
    docs = spark.createDataFrame([(1, "the worst"), (2, None)], "doc_id bigint, text string")
    for entries, passes in ((None, 1), ([("worst", "global", 1), ("the", "global", 2), ("a", "global", 3)], 3), ([], 1)):
        spans = prose.prose_spans(docs, ["doc_id"], entries, most=1 if entries else prose.ENTRIES)
        assert spans._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == passes
        assert {r.doc_id: len(r.spans) for r in spans.collect()} == {1: 1 if entries is None else len((entries or [])[:2]), 2: 0}
