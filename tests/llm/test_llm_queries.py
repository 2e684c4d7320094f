"""Every query of the subpackage against SQL, or a brute-force version where SQL can't say it."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from conftest import DATA, same_rows
from corpusgate.llm import queries as llm

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_same_as_sql(spark, name):
    same_rows(llm.QUERIES[name](spark, str(DATA)), llm.ORACLES[name])


def test_registered():
    import __spark_entry__ as entry

    assert {*llm.QUERIES, "pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in llm.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_tokens_as_the_library_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(llm.vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for row in llm.op6_tokens(spark, str(DATA)).collect():
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 512)


def test_languages_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = llm.op4_langid(spark, str(DATA)).join(docs, "doc_id").filter("held_out")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 40
    assert right >= 0.97 * n


def test_pages_of_the_table(spark):
    """These pages keep their article in one element; that element's text is what is wanted."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for row in llm.op10_extraction(spark, str(DATA)).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id], re.DOTALL).group(1)
        blocks = re.split(r"<(?:/?p|/?h1)>", article.replace("<br>", " "))
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert row.text == "\n".join(x for x in lines if x)
        assert row.n_chars == len(row.text)


def test_pipeline_stage_by_stage(spark):
    """Brute force for each stage on what the one before it kept."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "near duplicates", "decontamination", "mixing", "sharding"]
    out = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-pipeline-{name.replace(' ', '-')}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(out["language"]) == 200  # every document of this table has letters of one language in the main
    sets = {r.doc_id: shingles(r.text) for r in out["language"]}
    kept = {r.doc_id for r in out["near duplicates"]}
    assert kept == {min(group) for group in groups(sets)}
    benchmark = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in out["near duplicates"] if not contaminated(r.text, benchmark)}
    assert {r.doc_id for r in out["decontamination"]} == clean
    times = [r.doc_id for r in out["mixing"]]
    assert Counter(times) == mixed_times(out["decontamination"])
    assert set(times) <= clean
    assert max(map(times.count, times)) <= 2
    assert sorted(times) == sorted(r.doc_id for r in out["sharding"])
    by_shard: dict[str, int] = {}
    for r in out["sharding"]:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + len(r.text.encode())
    assert all(r.shard_bytes == by_shard[r.shard] and (r.oversized or r.shard_bytes <= 8 << 20) for r in out["sharding"])


def mixed_times(rows: list) -> Counter:
    """How often the mix takes each document: queues in shuffled order, twice over, up to the source's target."""
    sizes = {r.doc_id: len(r.text.encode().split()) for r in rows}
    queues: dict = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(f"mix-1|{r.doc_id}".encode()).hexdigest()[:12]):
        queues.setdefault(r.source, []).append(r.doc_id)
    names = sorted(queues, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    source = {s: sum(sizes[i] for i in queues[s]) for s in names}
    budget, full, target = 1.5 * sum(source.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(2 * source[s] for s in full)
        target = {s: 2 * source[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 2 * source[s]}
        if not over:
            break
        full |= over
    times: Counter = Counter()
    for s in names:
        at = 0
        for i in queues[s] * 2:
            times[i] += at < round(target[s]) and sizes[i] > 0
            at += sizes[i]
    return +times


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Repeated rows, rows without doc_id, source or text, and an empty table."""
    import corpus_pipeline as pipeline

    text = lambda n: " ".join(f"the word{n}x{i} and of it" for i in range(30))
    rows = [(1, text(1), "en", "a"), (1, text(1), "en", "a"), (1, text(2), "en", "a"), (None, text(2), None, None), (None, text(3), "en", None)]
    rows += [(None, text(3), "en", None), (7, None, None, "a"), (8, "", "en", "b"), (9, "123 456", "en", "b"), (10, "x " * 50_000, "en", "b")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, part in (("odd", rows), ("empty", [])):
        spark.createDataFrame([(*r, len(r[1] or "")) for r in part], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, "nothing of this")], "item_id bigint, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = pipeline.run(spark, str(tmp_path / name)).collect()
        assert {(r.doc_id, r.text) for r in out} <= {(1, text(1)), (1, text(2)), (None, text(3)), (10, "x " * 50_000)}
        assert len(out) == len(set(out)) or not part or max(Counter(out).values()) <= 2
        assert bool(out) == bool(part)


def shingles(text: str) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(sets: dict) -> list[set]:
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    out: dict = {}
    for k in keys:
        out.setdefault(root(k), set()).add(k)
    return list(out.values())


def contaminated(text: str, items: list[str]) -> bool:
    import re

    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    own = words(text)
    for item in items:
        w = words(item)
        m = min(10, len(w))
        wanted = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        if any(tuple(own[i : i + m]) in wanted for i in range(len(own) - m + 1)):
            return True
    return False
