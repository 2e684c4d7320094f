"""Small files with known findings, dealt to parts by p_partkey: the answer of a query is a CASE over the template.

Each template is a path (%d is the part), a text and what scans find in it. Texts have no single quotes and no
backslashes, so that one SQL literal serves both engines.
"""

from __future__ import annotations

#: name: (path, text, [(line, class, message, blocking)])
PYTHON = {
    "dead": (
        "src/a%d.py",
        "def f(x):\n    return x\n    x = 2\n\n\nwhile False:\n    f(1)\n",
        [(3, "Q5", "unreachable statement", False), (6, "Q5", "branch with a constant false condition", False), (3, "M11", "unnamed numeric literal 2", False)],
    ),
    "loop": (
        "src/b%d.py",
        "def g(d):\n    for k in d.keys():\n        d.pop(k)\n    for x in d:\n        del d[x]\n        print(x)\n",
        [
            (3, "Q8", "'d' mutated while iterating over it", False),
            (5, "Q8", "'d' mutated while iterating over it", False),
            (6, "M17", "print() call left in code", False),
        ],
    ),
    "recursion": (
        "src/c%d.py",
        "def h(n):\n    return h(n - 1)\n\n\ndef k(n, depth):\n    if depth > 1:\n        return n\n    return k(n, depth)\n\n\nclass A:\n    def m(self):\n        return self.m()\n",
        [(1, "Q9", "'h' recurses without an enforced depth limit", False), (12, "Q9", "'m' recurses without an enforced depth limit", False)],
    ),
    "leak": (
        "lib/d%d.py",
        'import socket\n\n\ndef a(p):\n    f = open(p)\n    return f.read()\n\n\ndef b(p):\n    with open(p) as f:\n        return f.read()\n\n\ndef c(p):\n'
        "    f = open(p)\n    try:\n        return f.read()\n    finally:\n        f.close()\n\n\ndef d(lock):\n    lock.acquire()\n    return socket.socket()\n",
        [(5, "Q11", "'open' result has no guaranteed release", True), (23, "Q11", "'lock.acquire' result has no guaranteed release", True)],
    ),
    "defaults": (
        "lib/e%d.py",
        "import collections\n\n\ndef a(x=[], *, y=dict(), z=None):\n    return x, y, z\n\n\nb = lambda q={}: q\n",
        [(4, "Q13", "mutable default argument", False), (8, "Q13", "mutable default argument", False)],
    ),
    "catch": (
        "lib/f%d.py",
        "try:\n    a()\nexcept ValueError:\n    pass\nexcept Exception as e:\n    log(e)\nexcept (KeyError, BaseException):\n    raise\n",
        [(3, "M1", "exception handler swallows the error", True), (5, "M16", "broad exception handler without re-raise", False)],
    ),
    "numbers": (
        "src/g%d.py",
        "LIMIT = 40\nx = 3.5\ny = -7\nz = x * 1 + True\nA = B = 9\n",
        [(2, "M11", "unnamed numeric literal 3.5", False), (3, "M11", "unnamed numeric literal 7", False)],
    ),
    "stubs": (
        "src/h%d.py",
        'from abc import abstractmethod\n\n\nclass P(Protocol):\n    def a(self): ...\n\n\nclass Q:\n    def b(self):\n        """Later."""\n        pass\n\n    @abstractmethod\n'
        "    def c(self): ...\n\n    def d(self):\n        raise NotImplementedError\n\n    def e(self):\n        raise NotImplementedError(1)\n",
        [(9, "M12", "'b' has a stub body", True), (17, "M12", "NotImplementedError without a message", True)],
    ),
    "debug": (
        "src/i%d.py",
        'import pdb\nfrom os import path\n\nbreakpoint()\nif __name__ == "__main__":\n    print(path)\n',
        [(1, "M17", "debugger import", False), (4, "M17", "breakpoint() call left in code", False)],
    ),
    "broken": ("src/j%d.py", "def f(:\n    return 7\n", []),
    "clean": ("src/k%d.py", "import numpy as np\nfrom .local import x\nfrom yaml.nodes import Node\n\n\ndef f(a):\n    return np.sum(a) + x, Node\n", []),
    "regex": (
        "src/l%d.py",
        'import re\n\nA = re.compile("(a+)+")\nB = re.search("(x|x)*y", A)\nC = re.match("(a|b)+", B)\nD = re.sub("(ab{2,3})*", B, C)\n',
        [
            (3, "Q3", "regex nested quantifier: (a+)+", False),
            (4, "Q3", "regex overlapping alternation under a quantifier: (x|x)*y", False),
            (6, "Q3", "regex nested quantifier: (ab{2,3})*", False),
        ],
    ),
}
WEB = {
    "catch": (
        "web/a%d.ts",
        "try { f() } catch (e) { }\ng()\ntry { h() }\ncatch\n{\n}\ncatch (e) { log(e) }\n",
        [(1, "M1", "empty catch block", True), (4, "M1", "empty catch block", True)],
    ),
    "regex": (
        "web/b%d.js",
        'const a = /(a*)*b/;\nconst b = x / y / z;\nif (/[/]+c/.test(s)) { }\nconst c = new RegExp("(z|z)+");\n',
        [(1, "Q3", "regex nested quantifier: (a*)*b", False), (4, "Q3", "regex overlapping alternation under a quantifier: (z|z)+", False)],
    ),
    "clean": ("web/c%d.js", 'import x from "react";\nconst y = require("./local");\n', []),
}
#: name: (path, text, [(check, line, message)])
TREE = {
    "docker-root": ("app%d/Dockerfile", "FROM alpine AS a\nUSER app\nFROM alpine\nRUN x\n", [("root-user", 0, "final build stage has no non-root USER")]),
    "docker-user": ("app%d/Dockerfile.dev", "FROM alpine\nUSER root\nRUN <<EOF\nUSER root\nEOF\nUSER 1000:1000 # plain\n", []),
    "docker-variable": ("app%d/containerfile", "FROM alpine\nUSER $NAME\n", [("root-user", 0, "final build stage has no non-root USER")]),
    "compose": (
        "app%d/compose.yml",
        'services:\n  web:\n    image: a\n    user: "1000"\n  db:\n    image: b\n  job:\n    user: root\n',
        [("root-user", 6, "service 'db' has no non-root user"), ("root-user", 8, "service 'job' has no non-root user")],
    ),
    "pod": (
        "k8s/pod%d.yaml",
        "apiVersion: v1\nkind: Pod\nspec:\n  securityContext:\n    runAsNonRoot: true\n  containers:\n  - name: a\n  - name: b\n    securityContext:\n      runAsUser: 0\n",
        [("root-user", 8, "container 'b' is not non-root")],
    ),
    "bad-yaml": ("k8s/bad%d.yml", "a: [1\n", [("root-user", 0, "malformed YAML cannot be checked")]),
    "workflow": (
        ".github/workflows/w%d.yml",
        "jobs:\n  a:\n    steps:\n    - uses: actions/checkout@v4\n    - uses: ./local\n    - uses: a/b@0123456789012345678901234567890123456789\n",
        [("action-pin", 0, "action 'actions/checkout@v4' must use a full commit SHA")],
    ),
    "hash-js": (
        "web/h%d.js",
        'createHash("md5");\ncreateHash("sha1"); // non-security cache key\nmd5(x) // non-security token\n',
        [("weak-hash", 1, "MD5/SHA-1 call without a justification comment"), ("weak-hash", 3, "MD5/SHA-1 call without a justification comment")],
    ),
    "hash-py": (
        "src/h%d.py",
        'import hashlib as h\nfrom hashlib import sha1 as s\nn, m = h.md5, h.sha256\nn(b"")\ns(b"")  # non-cryptographic checksum\nm(b"")\nh.new("MD5")\n',
        [("weak-hash", 4, "MD5/SHA-1 call without a justification comment"), ("weak-hash", 7, "MD5/SHA-1 call without a justification comment")],
    ),
    "hash-broken": ("src/hb%d.py", "def (:\n", [("weak-hash", 0, "malformed Python cannot be checked")]),
    "hash-fixture": ("eval/cases/c%d/input.py", "def (:\n", []),
    "conflict": (
        "docs/c%d.txt",
        "a\n<<<<<<< ours\nb\n=======\nc\n>>>>>>> theirs\n>>>>>>> stray\n<<<<<<< open\n",
        [
            ("conflict", 2, "unresolved conflict block to line 6"),
            ("conflict", 7, "orphan conflict marker closer"),
            ("conflict", 8, "unclosed conflict marker opener"),
        ],
    ),
    "heading": ("docs/c%d.md", "Title\n=====\n\n====\n", [("conflict", 4, "orphan conflict marker separator")]),
}
#: name: (path, text, [(line, message)])
MANIFESTS = {
    "package": (
        "app%d/package.json",
        '{"dependencies": {"a": "1.2.3", "b": "^1.0.0", "c": "file:../c"}, "devDependencies": ["x"], "optionalDependencies": {"d": "git+x#0123456789012345678901234567890123456789"}}',
        [(1, "'b' uses unpinned spec '^1.0.0'")],
    ),
    "requirements": (
        "app%d/requirements-dev.txt",
        "# tools\na==1.0\nb>=2\n-r other.txt\nc[x]==1.5 ; python_version > 3\nd @ https://x.io/d.whl#sha256=00\ne # any\n",
        [(3, "unpinned requirement 'b>=2'"), (7, "unpinned requirement 'e'")],
    ),
    "pyproject": (
        "app%d/pyproject.toml",
        '[project]\ndependencies = ["a==1.0", "b"]\n[project.optional-dependencies]\nx = ["c~=1.1"]\n[tool.poetry.dependencies]\npython = "^3"\nd = "=1.2.3"\ne = {version = "^1"}\nf = {path = "../f"}\n',
        [(1, "unpinned requirement 'b'"), (1, "unpinned requirement 'c~=1.1'"), (1, "'e' uses unpinned spec '^1'")],
    ),
    "cargo": (
        "app%d/Cargo.toml",
        '[dependencies]\na = "1.0"\nb = "=1.0.1"\n[dev-dependencies]\nc = {git = "x", rev = "1"}\nd = {version = "2"}\n',
        [(1, "'a' uses unpinned spec '1.0'"), (1, "'d' uses unpinned spec '2'")],
    ),
    "bad-toml": ("lib%d/Cargo.toml", "[dependencies\n", []),
    "bad-json": ("lib%d/package.json", "{", []),
}


def _literal(text: str) -> str:
    assert "'" not in text and "\\" not in text, text
    return "'" + text.replace("{", "{{").replace("}", "}}") + "'"


def files_view(samples: dict) -> str:
    """A SELECT of repo, rev, path, blob_id, mode, text over {part}: part p has sample p modulo their number."""
    rows = ", ".join(f"({i}, {_literal(path.split('%d')[0])}, {_literal(path.split('%d')[1])}, {_literal(text)})" for i, (path, text, _) in enumerate(samples.values()))
    return f"""
SELECT p_brand AS repo, 'head' AS rev, a || CAST(p_partkey AS STRING) || b AS path, md5(text) AS blob_id, '100644' AS mode, text
FROM {{part}} AS p JOIN (VALUES {rows}) AS t(k, a, b, text) ON p.p_partkey % {len(samples)} = t.k"""


def _value(x: object) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def expected(samples: dict, columns: str, pick=lambda row: True) -> str:
    """DuckDB's SELECT of repo, rev, path and the columns of what scans find in the samples."""
    rows = []
    for i, (path, _, found) in enumerate(samples.values()):
        a, b = path.split("%d")
        rows += [f"({i}, '{a}', '{b}', {', '.join(map(_value, row))})" for row in found if pick(row)]
    return (
        f"SELECT p_brand AS repo, 'head' AS rev, a || CAST(p_partkey AS VARCHAR) || b AS path, {columns} "
        f"FROM part JOIN (VALUES {', '.join(rows)}) AS t(k, a, b, {columns}) ON p_partkey % {len(samples)} = t.k"
    )
