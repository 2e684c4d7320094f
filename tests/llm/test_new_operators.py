"""Toxicity, periodic runs and alignment of tokenizers: against brute force, held-out labels and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from corpusgate.llm import alignment, periodic, toxicity
from corpusgate.llm import queries as llm

needs_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")
SCHEMA = "doc_id bigint, text string, lang string, source string, kind string, block string, key string, score string, start int, runs string"
ODD = [(1, "one two  three\nfour"), (1, "one two  three\nfour"), (2, None), (3, ""), (None, "no identifier here"), (4, " \t\n "), (5, "é 漢字 😀 x y"), (6, "a b " * 3000)]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, "en", "s", "k", "b", "y", "z", 1, "r") for r in rows], SCHEMA)


def runs_by_brute_force(ids: list[int], shortest: int, least: int) -> list[tuple[int, int, int]]:
    """Every period from the smallest on; a stretch that a smaller period has is no run of a greater one."""
    found, n = {}, len(ids)
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, least * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 4)):
            size, letters, text = rng.randint(0, 70), rng.choice([1, 2, 3]), []
            while len(text) < size:
                if rng.random() < 0.5:
                    text += [rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
                else:
                    text += [rng.randrange(letters + 3) for _ in range(rng.randint(1, 5))]
            texts.append(text)
        shortest, least = rng.choice([(2, 2), (6, 3), (24, 3)])
        wanted = [runs_by_brute_force(t, shortest, least) for t in texts]
        assert periodic.runs_of_texts(texts, shortest, least, block=rng.choice([10, 100, 1000])) == wanted


def wanted_runs(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number: dict = {}
    runs = runs_by_brute_force([number.setdefault(w, len(number)) for w in words], 24, 3)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    short = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(short.encode()).hexdigest())


@needs_tables
def test_runs_of_the_table(spark):
    rows = llm.op12_runs(spark, str(DATA)).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    short = {i for i, t in texts.items() if len(t or "") < 30_000}
    assert len(rows) == len(texts)
    assert {tuple(r) for r in rows if r.doc_id in short} == {wanted_runs(i, texts[i]) for i in short}
    assert any(r.n_runs for r in rows)


def test_runs_of_odd_rows(spark):
    digest = lambda docs: periodic.digested(periodic.periodic_runs(docs.withColumn("text", periodic.made_periodic(F.col("doc_id"), F.col("text")))))
    assert sorted(map(str, map(tuple, digest(odd(spark)).collect()))) == sorted(str(wanted_runs(i, t)) for i, t in ODD)
    assert digest(odd(spark).limit(0)).count() == 0
    long = odd(spark, [(7, " ".join(["one", "two", "three"] * 100_000) + " end")])
    found = periodic.periodic_runs(long).first()
    assert (found.n_words, [tuple(r) for r in found.runs], found.collapsed) == (300_001, [(0, 300_000, 3)], "one two three end")


def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(llm.vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=llm.vocabulary("piece_bpe_32k.model"))


def wanted_alignment(texts: list[tuple]) -> list[tuple]:
    """Each text by the libraries as a whole, groups and links walked token by token, pairs counted over all."""
    a, b = libraries()
    with open(llm.vocabulary(), encoding="utf-8") as one, open(llm.vocabulary("piece_bpe_32k.model"), "rb") as other:
        both = alignment.Tokenizers(one.read(), other.read())
    rows, documents = [], Counter()
    for key, text in texts:
        data = f" {text}".encode()
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a, parts_b = [both.a_bytes[i] for i in ids_a], [both.b_bytes[i] for i in ids_b]
        groups, links = [], []
        if text and b"".join(parts_a) == data == b"".join(parts_b):
            i = j = end_a = end_b = 0
            of_a: list = []
            of_b: list = []
            while i < len(ids_a) or j < len(ids_b):
                if end_a <= end_b:
                    end_a += len(parts_a[i])
                    of_a.append(ids_a[i])
                    i += 1
                else:
                    end_b += len(parts_b[j])
                    of_b.append(ids_b[j])
                    j += 1
                if end_a == end_b:
                    groups.append((of_a, of_b))
                    of_a, of_b = [], []
            spans = lambda ids, parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1])), x) for k, x in enumerate(ids)]
            if len(ids_a) < 60:  # every pair of tokens, asked for overlap
                links = [(x, y) for s, e, x in spans(ids_a, parts_a) for s2, e2, y in spans(ids_b, parts_b) if s < e2 and s2 < e]
            else:
                i = j = 0
                end_a, end_b = len(parts_a[0]), len(parts_b[0])
                while True:
                    links.append((ids_a[i], ids_b[j]))
                    step_a, step_b = end_a <= end_b, end_b <= end_a
                    i, j = i + step_a, j + step_b
                    if i == len(ids_a):
                        break
                    end_a += len(parts_a[i]) if step_a else 0
                    end_b += len(parts_b[j]) if step_b else 0
        else:
            ids_a = ids_b = []
        documents.update(set(links))
        rows.append((key, ids_a, ids_b, groups, links))
    best: dict = {}
    for (x, _), n in documents.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for key, ids_a, ids_b, groups, links in rows:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = [documents[p] for p in links]
        n_best = sum(documents[p] == best[p[0]] for p in links)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), n_best, sum(counts), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs, **more):
    found = alignment.align(docs, llm.vocabulary(), llm.vocabulary("piece_bpe_32k.model"), **more)
    return sorted(map(str, map(tuple, alignment.digested(found.documents).select(*COLUMNS).collect())))


@needs_tables
def test_alignment_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(str, map(tuple, llm.op13_alignment(spark, str(DATA)).select(*COLUMNS).collect()))) == sorted(map(str, wanted_alignment(texts)))


def test_alignment_of_odd_rows(spark):
    rng = random.Random(3)
    signs = "abcXYZ019 \n\t.,'!?-_éß漢字😀▁\x00\x1c\x85\xa0 　​́٣²" + " " * 8
    made = [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows = [*ODD, *made, (7, "<|endoftext|> <s> <0x41> </s><unk>"), (8, "x" * 50_000), (9, "ends in space "), (10, " starts"), (11, "▁x")]
    docs = odd(spark, rows).repartition(3)
    wanted = sorted(map(str, wanted_alignment(rows)))
    assert aligned(docs) == wanted
    assert aligned(docs, block_bytes=50) == wanted
    assert aligned(odd(spark).limit(0)) == []


def test_pairs_of_an_alignment(spark):
    docs = odd(spark, [(1, "hello hello world"), (2, "hello"), (3, None)])
    pairs = alignment.align(docs, llm.vocabulary(), llm.vocabulary("piece_bpe_32k.model")).pairs.collect()
    a, b = libraries()
    assert {(r.id_a, r.id_b): (r.documents, r.is_best) for r in pairs}[a.encode(" hello").ids[0], b.encode("hello")[0]] == (2, True)


def test_swaps():
    groups = (("men", "women", "girls"),)
    assert toxicity.swapped({"men", "walk"}, groups, 2) == [{"walk"}, {"walk", "women"}, {"walk", "girls"}]
    assert toxicity.swapped({"walk"}, groups) == []
    assert ({"men"}, {"women", "wom*", "wome*"}) in toxicity.changes_of({"men"}, groups)


def made_labels(n: int = 600):
    """Toxic texts name one group mostly, others another; a word of insult tells the label."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(["river", "table", "walks", "green", "house", "slow", "paper"]) for _ in range(12)]
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(["idiot", "scum"]))
        if rng.random() < 0.6:
            words.append("muslims" if toxic else rng.choice(["christians", "jews"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_counterfactuals_even_out_groups(spark):
    rows = made_labels()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    plain, fair = (toxicity.train(docs, labels, even=e) for e in (0.0, toxicity.EVEN))
    neutral = spark.createDataFrame([(1, "the muslims walk by the river"), (2, "the christians walk by the river"), (3, "you scum"), (4, None)], "doc_id bigint, text string")
    before, after = ({r.doc_id: r.score for r in toxicity.score(neutral, m).collect()} for m in (plain, fair))
    assert before[1] - before[2] > 0.3
    assert abs(after[1] - after[2]) < 0.05
    assert after[1] < 0.5 <= after[3]
    assert after[4] < 0.5


@needs_tables
def test_toxicity_held_out(spark):
    from pathlib import Path

    folder = next((f for f in (DATA.parent / "sf0.1", DATA.parent / "sf0.01", DATA) if Path(f).is_dir()), DATA)
    rows = llm.op11_toxicity(spark, str(folder)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    caught, toxic, wrong, clean = rows.selectExpr("sum(predicted * toxic)", "sum(toxic)", "sum(predicted * (1 - toxic))", "sum(1 - toxic)").first()
    assert caught >= 0.8 * toxic
    assert wrong <= 0.01 * clean


def test_toxicity_learns_from_no_held_out_label(spark):
    rows = made_labels(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 0), (None, 1, 1), (5, 1, None), (6, 1, 7), (1, 0, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (odd(spark), odd(spark).limit(0)):
        for some in (labels, labels.limit(0)):
            rows = toxicity.predicted(docs, some).collect()
            assert len(rows) == docs.count()
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
            by_text = {}
            assert all(by_text.setdefault(r.doc_id, r.score) == r.score for r in rows)


def secrets_by_brute_force(text: str) -> list[tuple[int, int, str]]:
    """Every class's candidates that are clear of base spans and not allowed, with a window of enough entropy; then wide ones before narrow ones."""
    import math

    from corpusgate.llm import secrets

    def entropy(s):
        windows = [s[i : i + secrets.WINDOW] for i in range(len(s) - secrets.WINDOW + 1)]
        return max((-sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in Counter(w).values()) for w in windows), default=0)

    def allowed(s):
        words = re.fullmatch(r"[/_+-]*(?:(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)[/_+-]+)+(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)?[0-9]{0,4}", s)
        rest = re.sub(secrets._PLACEHOLDER, "", s)
        return bool(re.search(secrets._UUID, s) or words or (rest != s and len(rest) < secrets.WINDOW))

    base = []
    for pattern, head, least in secrets.PATTERNS.values():
        base += [m.span() for m in re.finditer(pattern, text) if len(re.sub(head, "", m[0]) if head else m[0]) >= least]
    apart = lambda span, spans: all(span[1] <= a or b <= span[0] for a, b in spans)
    out: list[tuple[int, int, str]] = []
    for kind, (pattern, needed, least) in secrets.CLASSES.items():
        found = [m for m in re.finditer(pattern, text) if all(re.search(n, m[0]) for n in needed) and not allowed(m[0]) and apart(m.span(), base)]
        taken = [(a, b) for a, b, _ in out]
        out += [(*m.span(), kind) for m in found if entropy(m[0]) >= least - 1e-9 and apart(m.span(), taken)]
    return sorted(out)


def test_added_secrets_by_brute_force(spark):
    from corpusgate.llm import secrets

    rng = random.Random(8)
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    parts = ["Xk29fjLqP0sd83ncMWq2z", "A" * 20 + "1", "QWERT1YUIOP2ASDFG3HJKL4Z", "q1w2e3r4t5y6u7i8o9p0a", "the words", "password = hunter2hunter2", "a" * 30 + "1", "some_long_snake_case_name", "-", " ", " ", "x"]
    texts = ["Xk29fjLqP0sd83ncMWq2z", "Xk29fjLqP0sd83ncMWq2z" + "A" * 20 + "1", "".join(rng.choice(wide) for _ in range(30_000))]
    texts += ["".join(rng.choice([*parts, "".join(rng.choice(wide) for _ in range(24))]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: sorted((m.start, m.end, m.kind) for m in r.entropy) for r in secrets.scan(docs).collect()}
    assert found == {i: secrets_by_brute_force(t) for i, t in enumerate(texts)}
    assert [found[i] for i in range(3)] == [[(0, 21, "b64")], [(0, 42, "b64")], [(0, 30_000, "b64")]]


def test_likeness_of_texts_without_signs(spark):
    from corpusgate.llm import fingerprints

    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (20, 30, 60, 200) for _ in range(60)]
    texts += [" ".join(f"{w}***" for w in rng.choices(words, k=80)) for _ in range(20)]
    rows = fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    short, long = [r for r in rows if r.doc_id < 120], [r for r in rows if r.doc_id >= 120]
    assert all(r.near_edited > max(0.25, r.near_next) for r in long)
    assert sum(r.near_edited > r.near_next for r in short) >= 0.95 * len(short)
