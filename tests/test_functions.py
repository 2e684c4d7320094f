"""Column functions against Python's own, and the helpers' rules by positive and negative cases."""

from __future__ import annotations

import pathlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgate.functions import filerules, prosetext, pyrules, regexrules
from corpusgate.functions import text as T
from corpusgate.operators import commits, content, dependencies, diffs, packing, policy, prose, reports

ENDS = "ab \n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029é"


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(ENDS, max_size=15), min_size=50, max_size=80))
def test_splitlines(spark, texts):
    assert column(spark, texts, T.splitlines) == [t.splitlines() for t in texts]


def test_no_limits(spark):
    from corpusgate.jobs import workloads
    from corpusgate.operators import filescan

    bad = "import hashlib\n" + "hashlib.md5(b'')\n" * 30
    files = [("r", "1", f"f{i}.py", f"b{i}", "100644", f"{bad}# {i}\n") for i in range(40)] + [("r", "1", "z.txt", "z", "100644", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n")]
    tree = spark.createDataFrame(files, "repo string, rev string, path string, blob_id string, mode string, text string")
    got = {r.check: r["count"] for r in filescan.compliance_scan(tree, limit=None).groupBy("check").count().collect()}
    assert got["weak-hash"] == 1200 and "limit" not in got
    assert len(got) == 2
    history = spark.createDataFrame([], "repo string, sha string, seq int, subject string, body string, is_merge boolean, author_name string, author_email string, author_login string, committer_name string, committer_email string, committer_login string")
    none = spark.createDataFrame([], "repo string, branch string")
    approved = spark.createDataFrame([], "name string, email string")
    rules = {r.rule: r["count"] for r in workloads.audit(tree, history, none, approved).groupBy("rule").count().collect()}
    assert rules == got
    chunks = spark.createDataFrame([(1,), (20,), (21,), (None,)], "chunk int")
    assert [r.overflow for r in packing.limit_chunks(chunks, None).collect()] == [False] * 4


def test_suffix(spark):
    names = "a.py .bashrc a. a.b.c x/.y.z ..a ... a..b noext .a.b b.tar.gz a/.hidden".split()
    assert column(spark, names, T.suffix) == [pathlib.PurePosixPath(n).suffix for n in names]


def test_is_test_path(spark):
    yes = ["tests/a.py", "x/spec/y.rb", "test_a.py", "a_test.go", "a.spec.ts", "b.test.js", "a_test.x.y"]
    no = ["src/a.py", "spec", "contest.py", "a_tests.go", "latest/x.py"]
    assert column(spark, yes + no, T.is_test_path) == [True] * len(yes) + [False] * len(no)


def test_documentation_hosts(spark):
    yes = ["example.com", "a.Example.org", "localhost", "x.localhost", "a.test", "b.invalid"]
    no = ["notexample.com", "example.com.evil.io", "test", "a.tests", ""]
    assert column(spark, yes + no, T.is_documentation_host) == [True] * len(yes) + [False] * len(no)


def test_match_starts_and_lines(spark):
    texts = ["", "catch {}", "é\ncatch(e){\n}x catch{}", "no"]
    found = column(spark, texts, lambda x: T.match_starts(x, "catch\\s*(\\(e\\))?\\{\\s*\\}"))
    assert found == [[], [0], [2, 15], []]
    assert column(spark, ["a\nbc\rd"], lambda x: T.line_of(x, F.lit(3))) == [2]
    assert column(spark, ["a\nbc"], lambda x: T.column_of(x, F.lit(3))) == [2]


def test_escaped_size(spark):
    import json

    texts = ['"', "\\", "\n\t\x01", "漢字", "😀", "\x7f", "\u2028", ""]
    assert column(spark, texts, T.escaped_size) == [len(json.dumps(t, ensure_ascii=False).encode()) - 2 for t in texts]


def test_cleaning(spark):
    from corpusgate.functions.ship import ship

    ship(spark)
    assert column(spark, ["a\x01b\tpassword: x y"], T.clean_control) == ["a?b\tpassword: <redacted> y"]
    assert column(spark, ["é\u200b", "x" * 300, None], T.sanitize_ascii(200)) == ["\\xe9\\u200b", "x" * 200 + "...[truncated]", None]


def test_logical_requirements(spark):
    found = column(spark, ["a==1 \\\n  --hash=sha256:0\nb\n\nc \\"], dependencies.logical_requirements)[0]
    assert [(r.line, r.requirement) for r in found] == [(1, "a==1"), (3, "b"), (4, ""), (5, "c")]


def test_added_numbers(spark):
    patch = "+++ b/x\n@@ -1,2 +5,3 @@\n a\n+b\n-c\n\\ No newline\n++plus\n@@ -9 +20 @@ f\n+z"
    assert column(spark, [patch, "", "+x"], diffs.added_numbers) == [[6, 7, 20], [], []]


@pytest.mark.parametrize("glob", ["*.md", "a?c", "[ab]*.py", "[!a]*", "x/[", "a.b"])
def test_globs(spark, glob):
    import fnmatch

    names = ["x/y.md", "abc", "a.py", "b/c.py", "zebra", "x/[", "a.b", "aXb"]
    assert column(spark, names, lambda x: diffs.match_globs(x, [glob])) == [fnmatch.fnmatchcase(n, glob) for n in names]


@pytest.mark.parametrize("partitions", [1, 8])
def test_packing(spark, partitions):
    sizes = [5, 5, 11, 5, 6, 4, 10, 1]
    rows = spark.createDataFrame([(1, i + 1, f"f{i}", n) for i, n in enumerate(sizes)], "pr int, ord int, path string, cost int").repartition(partitions)
    out = {r.ord: (r.chunk, r.oversized) for r in packing.pack_chunks(rows, ["pr"], 10).collect()}
    assert out == {1: (1, False), 2: (1, False), 3: (None, True), 4: (2, False), 5: (3, False), 6: (3, False), 7: (4, False), 8: (5, False)}


def test_policy_fences(spark):
    text = "a - b\n```\nx - y\n``\n~~~\n```\n- `c - d` e\n```js\nq - r"
    rows = policy.line_violations(spark.createDataFrame([(1, text)], "k int, text string"), ["k"])
    assert [r.violation for r in rows.collect()] == ["line 1 uses a prose dash"]


def test_narration(spark):
    yes = ["I need to check", "Let me see", "x\nwait, no", "```\nlet me\n```", "I'll verify"]
    no = ["Input is fine", "`let me`", "a\n```\nlet me\n```\nb", "VERDICT_JSON: let me", "await x"]
    assert column(spark, yes + no, reports.process_narration) == [True] * len(yes) + [False] * len(no)


def test_trailers(spark):
    bodies = ["a\n\nK: v\nL:  w\n  more\n\n", "K: v\nplain", " folded\nK: v", "", "\n\n", "x\r\n\r\nK: v", None]
    found = column(spark, bodies, commits.trailers_of)
    assert [[(t.key, t.value) for t in f] if f is not None else None for f in found] == [
        [("K", "v"), ("L", "w\nmore")], [], [], [], [], [("K", "v")], None,
    ] or found[-1] == []


def test_branches(spark):
    names = ["main", "feat/x", "claude/x", "fix/damn-it", "fix/un-x-para", "docs/abc123d", "docs/sha256", "Feat/x"]
    counts = [len(x) for x in column(spark, names, commits.branch_rules)]
    assert counts == [0, 0, 1, 1, 1, 1, 0, 1]


@pytest.mark.parametrize(
    ("pattern", "hazard"),
    [
        ("(a+)+", regexrules.NESTED), ("(a*b){2,}", regexrules.NESTED), ("(x|x)*", regexrules.OVERLAPPING), ("((a+)b)*", regexrules.NESTED),
        ("(a|b)+", None), ("(a?)+", None), ("[(a+)+]", None), ("(a{1}b)+", None), ("(a+){2}", None), (r"\(a+\)+", None), ("(?:a|ab)+", regexrules.OVERLAPPING),
    ],
)
def test_hazards(pattern, hazard):
    assert regexrules.hazard(pattern) == hazard


@pytest.mark.parametrize(
    ("code", "classes"),
    [
        ("def f():\n    raise E\n    x()\n", {"Q5"}), ("if x:\n    pass\n", set()),
        ("for a in b:\n    b.append(a)\n", {"Q8"}), ("for a in list(b):\n    b.append(a)\n", set()),
        ("def f(depth):\n    if depth:\n        f(depth)\n", {"Q9"}), ("def f(depth):\n    if depth > 0:\n        f(depth)\n", set()),
        ("self.f = open(p)\n", set()), ("f = open(p)\n", {"Q11"}), ("stack.enter_context(open(p))\n", set()),
        ("def f(a=()):\n    return a\n", set()), ("def f(a={}):\n    return a\n", {"Q13"}),
        ("try:\n    x()\nexcept:\n    ...\n", {"M1"}), ("try:\n    x()\nexcept Exception:\n    raise\n", set()),
        ("X = 5\n", set()), ("x = 5\n", {"M11"}), ("x = True + 1\n", set()), ("def f():\n    pass\n", {"M12"}), ("def f():\n    'doc'\n", set()),
        ("print(1)\n", {"M17"}), ("if __name__ == '__main__':\n    print(1)\n", set()),
    ],
)
def test_python_rules(code, classes):
    index, failed = pyrules.parsed(code)
    assert failed is None
    assert {row[1] for rule in pyrules.RULES for row in rule(index)} == classes


def test_parser_limits():
    assert pyrules.parsed("(" * 5000 + ")" * 5000)[0] is None
    assert pyrules.parsed("def")[1] == "syntax"


def test_conflicts():
    say = lambda text, **k: [(n, m.split(" ")[0]) for n, m in filerules.conflicts(text, **k)]
    assert say("<<<<<<< a\n||||||| b\n=======\n>>>>>>> c\n") == [(1, "unresolved")]
    assert say("<<<<<<< a\n<<<<<<< b\n") == [(1, "unclosed"), (2, "unclosed")]
    assert say("<<<<<<< a\n=====\n>>>>> c\n") == [(2, "orphan"), (1, "unclosed"), (3, "mismatched")]
    assert say("T\n===\n") == [(2, "orphan")]
    assert say("T\n===\n", markdown=True) == []
    assert say("==\n") == []
    assert say("==\n", size=2) == [(1, "orphan")]
    assert len(say("===\n" * 200)) == filerules.MAX_CONFLICTS + 1


def test_decoding():
    assert filerules.decode("é".encode("utf-16"), "tree") == ("é", None)
    assert filerules.decode("plain text".encode("utf-16-le"), "tree") == ("plain text", None)
    assert filerules.decode(b"\xff\xe9", "conflict") == ("ÿé", None)
    assert filerules.decode(b"\xe9\x00", "conflict") == (None, None)
    assert filerules.decode(b"\xef\xbb\xbfa", "conflict") == ("a", None)
    assert filerules.inferred_utf(b"") is None


def test_decode_text(spark):
    rows = [(1, "é".encode()), (2, "é".encode("utf-16")), (3, b"\xe9"), (4, None), (5, b"a\x00b")]
    out = content.decode_text(spark.createDataFrame(rows, "i int, content binary"), "conflict").collect()
    assert {r.i: r.text for r in out} == {1: "é", 2: "é", 3: "é", 4: None, 5: "a\x00b"}


def test_read_tree_and_cases(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("x")
    (tmp_path / "a" / "node_modules" / "y.js").write_text("y")
    assert [r.path for r in content.read_tree(spark, str(tmp_path)).collect()] == ["a/x.py"]
    (tmp_path / "cases" / "one").mkdir(parents=True)
    for name in ("expected.json", "context.md", "diff.patch"):
        (tmp_path / "cases" / "one" / name).write_text(name)
    row = content.read_eval_cases(spark, str(tmp_path / "cases")).first()
    assert (row.slug, row.expected, row.context, row.files) == ("one", "expected.json", "context.md", {"diff.patch": "diff.patch"})


def test_prose_priority():
    found = prosetext.spans("The test was taken by us, which is worst.\n`I`\n", [("worst", 3)])
    assert [(f[2]) for f in found] == ["passive voice", "personal pronoun", "comma-led tail", "controlled vocabulary"]
    assert prosetext.masked("a `b\nc` d\n```\nx\n```\n") == "a   \n   d\n   \n \n   \n"


def test_prose_handoff(spark):
    rows = spark.createDataFrame([("a.md", "As discussed, this session."), (prose.HANDOFF, "As discussed, this session.")], "path string, text string")
    found = prose.prose_findings(rows, ["path"], path="path").groupBy("path").count().collect()
    assert {r.path: r["count"] for r in found} == {"a.md": 2}


def test_mask_in_both_engines(spark):
    """Fences of other widths and signs, inline code over lines, odd line ends, by a walk over lines and signs."""
    import random

    from corpusgate.functions import prosetext
    from corpusgate.operators.prose import mask_markdown_code

    def walked(text):
        out, fence, inline = "", None, False
        for line in text.splitlines(keepends=True):
            run = line.lstrip()
            sign = run[:1] if run[:3] in ("```", "~~~") else ""
            width = len(run) - len(run.lstrip(sign)) if sign else 0
            if fence or sign:
                out += "".join(c if c == "\n" else " " for c in line)
                inline = False
                if sign and not fence:
                    fence = (sign, width)
                elif sign and fence[0] == sign and width >= fence[1]:
                    fence = None
                continue
            for c in line:
                inline ^= c == "`"
                out += " " if c == "`" or inline and c != "\n" else c
        return out

    rng = random.Random(17)
    texts = ["".join(rng.choice(["`", "``", "```", "````", "~~~", "~~~~", "\n", "\n", "\n", "\r\n", "\x0b", "\u2028", " ", "\u3000", "a", "é😀"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    wanted = list(map(walked, texts))
    assert list(map(prosetext.masked, texts)) == wanted
    assert column(spark, texts, mask_markdown_code) == wanted


def test_limits_or_none():
    from corpusgate.functions import filerules

    conflict = "<<<<<<< a\n=======\n>>>>>>> b\n" * 150
    found = list(filerules.conflicts(conflict))
    assert len(found) == filerules.MAX_CONFLICTS + 1 and "reached violation limit" in found[-1][1]
    assert len(list(filerules.conflicts(conflict, limit=None))) == 150
    far = " " * 70_000
    assert list(filerules.conflicts(f"<<<<<<< {far}\n=======\n>>>>>>> b\n", limit=None, width=None))
    text = "import hashlib\n" + "hashlib.md5(b'')\n" * 1200
    capped, whole = list(filerules.weak_hash_python(text)), list(filerules.weak_hash_python(text, None))
    assert len(whole) == 1200 and len(capped) == filerules.MAX_HASHES + 1 and "reached" in capped[-1][1]
    script = "createHash('md5')\n" * 1200
    assert len(list(filerules.weak_hash_text(script, None))) == 1200
    assert len(list(filerules.weak_hash_text(script))) == filerules.MAX_HASHES + 1
    assert filerules.decode(b"abc", most=2)[1] and filerules.decode(b"abc", most=None) == ("abc", None)


def conflicts_restated(text, markdown, size):
    """Blocks found first, from each opener to what ends it; what is in none is an orphan."""
    lines = text.splitlines()
    marks = []
    for i, line in enumerate(lines):
        match = re.fullmatch(r"(<+|>+)( .*)?|(\|+) *( .*)?|(=+)", line)
        if match:
            signs = next(g for g in (match[1], match[3], match[5]) if g)
            marks.append((i, signs[0], len(signs)))
    told = lambda n: n >= 3 or n == size
    out, k = [], 0
    while k < len(marks):
        i, sign, n = marks[k]
        if sign != "<":
            heading = sign == "=" and markdown and filerules._is_heading(lines, i)
            if told(n) and not heading:
                out.append((i + 1, f"orphan conflict marker {'closer' if sign == '>' else 'separator'}"))
            k += 1
            continue
        inner = []
        k += 1
        while k < len(marks) and marks[k][1] not in "<>":
            inner.append(marks[k])
            k += 1
        parted = any(m == n for _, _, m in inner)
        rows = [(j + 1, "orphan conflict marker separator") for j, s, m in inner if m != n and told(m) and not (s == "=" and markdown and filerules._is_heading(lines, j))]
        closer = marks[k] if k < len(marks) and marks[k][1] == ">" else None
        if closer and closer[2] == n and parted:
            rows.append((i + 1, f"unresolved conflict block to line {closer[0] + 1}"))
        else:
            if told(n):
                rows.append((i + 1, "unclosed conflict marker opener"))
            if closer and told(closer[2]):
                rows.append((closer[0] + 1, "mismatched conflict marker closer"))
        out += rows
        k += closer is not None
    return out


@pytest.mark.parametrize("markdown", [False, True])
def test_conflicts_of_random_lines(markdown):
    rng = random.Random(markdown)
    for _ in range(3000):
        lines = []
        for _ in range(rng.randint(0, 12)):
            n = rng.choice([1, 2, 3, 7, 7, 7, 9, 17])
            lines.append(rng.choice(["<" * n, "<" * n + " ours", ">" * n, ">" * n + " theirs and more", "=" * n, "=" * n + " not a marker line", "|" * n + " base", "text", ""]))
        text, size = "\n".join(lines), rng.choice([None, 2, 7])
        wanted = conflicts_restated(text, markdown, size)
        for limits in ({}, {"limit": None, "width": None}):
            assert list(filerules.conflicts(text, markdown, size, **limits)) == wanted, text
    block = f"<<<<<<< a\n======= {'x' * 30}\n=======\n>>>>>>> {'b' * 50}\n"
    assert [n for n, _ in filerules.conflicts(block * 3, limit=2)] == [1, 5, 9]


def test_phrases_grouped_by_first_sign_match_as_one_by_one():
    import random
    import re

    from corpusgate.functions import prosetext

    rng = random.Random(8)
    lists = [prosetext.PRONOUNS, prosetext.HEDGES, prosetext.JUSTIFICATIONS, prosetext.HISTORY, prosetext.PROVENANCE, ("a b", "a", "B c", "#x", "-", "]"), (" a", "a"), ("\u00e9t\u00e9", "e"), ("one",)]
    for parts in lists:
        each = []
        for part in sorted(parts, key=lambda p: (-len(p), p)):
            body = r"\s+".join(map(re.escape, part.split(" ")))
            each.append(("(?<![A-Za-z])" if part[:1].isalnum() else "") + body + ("(?![A-Za-z])" if part[-1:].isalnum() else ""))
        plain, grouped = re.compile("|".join(each), re.IGNORECASE), re.compile(prosetext.bounded(*parts), re.IGNORECASE)
        for _ in range(300):
            text = "".join(rng.choice([p, p.upper(), p.title(), p[: len(p) // 2], p.replace(" ", "\n\t"), p.replace("s", "\u017f"), "x"]) + rng.choice(["", " ", ".", "\n", "1"]) for p in rng.choices(parts, k=12))
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in grouped.finditer(text)], (parts, text)
