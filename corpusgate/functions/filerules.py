"""Rules that read one file as a whole: conflict blocks, weak hashes, users of images and manifests, odd encodings.

Each takes a text and its path and yields rows; Spark spreads the files.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

#: line (0 for the whole file), message
Row = tuple[int, str]

#: Limits, patterns and words of the rules.
MAX_BYTES = 50 << 20
MAX_LINE = 65536
MAX_CONFLICTS = 100
MAX_HASHES = 1000
MARKER = re.compile(r"(?P<mark><+|>+)(?: .*)?$|(?P<base>\|+) *(?: .*)?$|(?P<parting>=+)$")
HASH_CALL = re.compile(
    r"hashlib\.(?:md5|sha1)\s*\(|createHash\(\s*['\"](?:md5|sha1)['\"]\s*\)|MessageDigest\.getInstance\(\s*['\"](?:md5|sha-?1)['\"]\s*\)|"
    r"\b(?:md5|sha1)\.New\s*\(|\b(?:MD5|SHA1)\.Create\s*\(|\b(?:md5|sha1)\s*\(|Digest::(?:MD5|SHA1)\b",
    re.IGNORECASE,
)
WEAK = ("md5", "sha1")
EXCUSES = ("non-security", "non-cryptographic")
SECURITY = ("authentication", "integrity", "password", "session", "signature", "token")
HASH_MESSAGE = "MD5/SHA-1 call without a justification comment"
FROM = re.compile(r"\s*FROM\s+\S+", re.IGNORECASE)
USER = re.compile(r"\s*USER\b(.*)$", re.IGNORECASE)
HEREDOC = re.compile(r"<<-?\s*(['\"]?)([A-Za-z0-9_.-]+)\1")
ESCAPE = re.compile(r"#\s*escape\s*=\s*([\\`])", re.IGNORECASE)
EXCEPTION = re.compile(r"\s*# runtime-root: this container .*\S.* \(Rule 12 exception\)\.\s*$")
CONTAINERS = ("containers", "initContainers", "ephemeralContainers")


def stopped(limit: int) -> str:
    return f"reached violation limit ({limit}), stopping"


def _is_heading(lines: list[str], i: int) -> bool:
    """Whether line i underlines a heading: a line of plain text is above it."""
    above = lines[i - 1].strip() if i else ""
    return bool(above) and not above.startswith(("```", "~~~", "#", "<", ">", "|", "="))


def conflicts(text: str, markdown: bool = False, size: int | None = None, limit: int | None = MAX_CONFLICTS, width: int | None = MAX_LINE) -> Iterator[Row]:
    """Conflict blocks and markers that belong to none, for markers of three characters and more, or of the given size.

    After `limit` findings a row says so and ends it; of a line, the first `width` characters are read. None: no limit."""
    lines = text.splitlines()
    opened: tuple[int, int] | None = None  # line and width of the open block
    parted = False
    said = 0
    matters = lambda n: n >= 3 or n == size
    for number, line in enumerate(lines, 1):
        if limit is not None and said >= limit:
            yield number, stopped(limit)
            break
        match = MARKER.match(line if width is None else line[:width])
        if match is None:
            continue
        mark = match["mark"] or match["base"] or match["parting"]
        kind, signs = mark[0], len(mark)
        rows: list[Row] = []
        if kind == "<":
            if opened and matters(opened[1]):
                rows.append((opened[0], "unclosed conflict marker opener"))
            opened, parted = (number, signs), False
        elif kind == ">":
            if opened and signs == opened[1] and parted:
                rows.append((opened[0], f"unresolved conflict block to line {number}"))
            else:
                if opened and matters(opened[1]):
                    rows.append((opened[0], "unclosed conflict marker opener"))
                if matters(signs):
                    rows.append((number, f"{'mismatched' if opened else 'orphan'} conflict marker closer"))
            opened = None
        elif opened and signs == opened[1]:
            parted = True
        elif matters(signs) and not (kind == "=" and markdown and _is_heading(lines, number - 1)):
            rows.append((number, "orphan conflict marker separator"))
        said += len(rows)
        yield from rows
    if opened and matters(opened[1]):
        yield opened[0], "unclosed conflict marker opener"


def excused(comment: str) -> bool:
    words = comment.lower()
    return any(w in words for w in EXCUSES) and not any(w in words for w in SECURITY)


def weak_hash_text(text: str, limit: int | None = MAX_HASHES) -> Iterator[Row]:
    """Calls that look like weak hashes; a comment right after the call, on its line, may excuse it."""
    said = 0
    for match in HASH_CALL.finditer(text):
        end = text.find("\n", match.end())
        tail = text[match.end() : end if end >= 0 else len(text)].lstrip(" ;")
        mark = next((m for m in ("#", "//") if tail.startswith(m)), None)
        if mark and excused(tail[len(mark) :].strip()):
            continue
        yield text.count("\n", 0, match.start()) + 1, HASH_MESSAGE
        said += 1
        if limit is not None and said >= limit:
            yield 0, stopped(limit)
            return


class _Hashes(ast.NodeVisitor):
    """Follows names that stand for hashlib (module), its weak functions (weak) or hashlib.new (new), in source order."""

    def __init__(self) -> None:
        self.names = {"hashlib": "module"}
        self.calls: list[ast.Call] = []

    def meaning(self, node: ast.AST | None) -> str | None:
        if isinstance(node, ast.Name):
            return self.names.get(node.id)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and self.names.get(node.value.id) == "module":
            return "weak" if node.attr in WEAK else "new" if node.attr == "new" else None
        return None

    def bind(self, target: ast.AST, value: ast.AST | None) -> None:
        several = (ast.Tuple, ast.List)
        if isinstance(target, several) and isinstance(value, several) and len(target.elts) == len(value.elts):
            for one, other in zip(target.elts, value.elts, strict=True):
                self.bind(one, other)
        elif isinstance(target, ast.Name) and (kind := self.meaning(value)):
            self.names[target.id] = kind

    def visit_Import(self, node: ast.Import) -> None:
        self.names |= {a.asname or a.name: "module" for a in node.names if a.name == "hashlib"}

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module == "hashlib":
            for a in node.names:
                given = [*WEAK, "new"] if a.name == "*" else [a.name]
                kinds = {n: "new" if n == "new" else "weak" for n in given if n in (*WEAK, "new")}
                self.names |= {a.asname or n: k for n, k in kinds.items()}

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for target in node.targets:
            self.bind(target, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.visit(node.value)
        self.bind(node.target, node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.visit(node.value)
        self.bind(node.target, node.value)

    def visit_Call(self, node: ast.Call) -> None:
        kind = self.meaning(node.func)
        named = next((k.value for k in node.keywords if k.arg == "name"), node.args[0] if node.args else None)
        by_name = isinstance(named, ast.Constant) and isinstance(named.value, str) and named.value.lower() in WEAK
        if kind == "weak" or kind == "new" and by_name:
            self.calls.append(node)
        self.generic_visit(node)


def weak_hash_python(text: str, limit: int | None = MAX_HASHES) -> Iterator[Row]:
    """Weak calls by what their names stand for; a file that can't be parsed is reported, not passed."""
    try:
        tree = ast.parse(text)
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
        hashes = _Hashes()
        hashes.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        yield 0, "malformed Python cannot be checked"
        return
    comments = {(t.start[0], t.start[1]): t.string[1:].strip() for t in tokens}
    for call in hashes.calls[:limit]:
        after = (x for (line, column), x in comments.items() if line == call.end_lineno and column >= call.end_col_offset)
        if not any(map(excused, after)):
            yield call.lineno, HASH_MESSAGE
    if limit is not None and len(hashes.calls) > limit:
        yield 0, stopped(limit)


def is_dockerfile(name: str) -> bool:
    return re.match(r"(?:dockerfile|containerfile)(?:$|[.-])", name) is not None


def is_root(value: object) -> bool:
    """Whether a user is root, or unknown: empty, a variable, a number of 0 or less."""
    if isinstance(value, int):
        return isinstance(value, bool) or value <= 0
    if not isinstance(value, str) or not value.strip() or "$" in value:
        return True
    name = value.split()[0].split(":")[0].strip().lower()
    number = name.lstrip("+-").isdigit()
    return name == "root" or number and int(name) <= 0


def instructions(text: str) -> list[str]:
    """Logical instructions: continued lines joined, bodies of here-documents left out. ValueError for one without an end."""
    lines = text.splitlines()
    first = next((x.strip() for x in lines if x.strip()), "")
    escape = match[1] if (match := ESCAPE.fullmatch(first)) else "\\"
    out: list[str] = []
    rest = iter(lines)
    for line in rest:
        while line.rstrip().endswith(escape):
            more = next(rest, None)
            if more is None:
                break
            line = line.rstrip()[:-1] + " " + more.lstrip()
        out.append(line)
        if line.split(None, 1)[:1] and line.split(None, 1)[0].upper() in ("RUN", "COPY", "ADD"):
            for mark in HEREDOC.finditer(line):
                tabs = mark.group().startswith("<<-")
                if not any((x.lstrip("\t") if tabs else x) == mark[2] for x in rest):
                    raise ValueError("here-document without an end")
    return out


def dockerfile_root(text: str) -> Iterator[Row]:
    """A final stage whose last user is root, or that names none."""
    try:
        steps = instructions(text)
    except ValueError:
        yield 0, "malformed Dockerfile cannot be checked"
        return
    starts = [i for i, x in enumerate(steps) if FROM.match(x)]
    stage = steps[starts[-1] :] if starts else steps
    users = [m[1].split(" #", 1)[0].strip() for m in map(USER.match, stage) if m]
    if not (users and not is_root(users[-1])) and not any(map(EXCEPTION.match, stage)):
        yield 0, "final build stage has no non-root USER"


def _mappings(root: object, seen: set[int]) -> Iterator[dict]:
    stack = [root]
    while stack:
        value = stack.pop()
        if not isinstance(value, (dict, list)) or id(value) in seen:
            continue
        seen.add(id(value))
        if isinstance(value, dict):
            yield value
        stack += reversed(list(value.values()) if isinstance(value, dict) else value)


def manifest_root(text: str) -> Iterator[Row]:
    """Services and containers that don't name a user other than root."""
    import yaml

    class Loader(yaml.SafeLoader):
        """Keeps the line of each mapping, under the key None, and refuses keys that repeat."""

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> Iterator[dict]:
        out: dict = {}
        yield out
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
        if len({*keys}) < len(keys):
            raise yaml.constructor.ConstructorError(None, None, "duplicate key", node.start_mark)
        loader.flatten_mapping(node)
        out |= {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}
        lines_of[id(out)] = node.start_mark.line

    lines_of: dict[int, int] = {}
    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        documents = list(yaml.load_all(text, Loader))  # noqa: S506 - derived from SafeLoader
    except (yaml.YAMLError, TypeError, RecursionError):
        yield 0, "malformed YAML cannot be checked"
        return
    lines = text.splitlines()
    indent = lambda i: len(lines[i]) - len(lines[i].lstrip(" "))

    def excepted(value: dict) -> bool:
        """An exception comment in the mapping, or right above it at its indentation."""
        at = lines_of.get(id(value), 0)
        end = next((i for i in range(at + 1, len(lines)) if lines[i].strip() and indent(i) <= indent(at)), len(lines)) if lines else 0
        above = at
        while above and lines[above - 1].strip().startswith("#") and indent(above - 1) == indent(at):
            above -= 1
        return any(map(EXCEPTION.match, lines[above:end]))

    for document in documents:
        services = document.get("services") if isinstance(document, dict) else None
        if isinstance(document, dict) and "services" in document and not isinstance(services, dict):
            yield 0, "services must be a mapping"
        for name, service in (services or {}).items() if isinstance(services, dict) else ():
            known = isinstance(service, dict)
            user = service.get("user") if known else None
            if not (known and excepted(service)) and (user is None or is_root(user)):
                yield lines_of.get(id(service), lines_of.get(id(services), 0)) + 1, f"service '{name}' has no non-root user"
    seen: set[int] = set()
    for document in documents:
        if not (isinstance(document, dict) and isinstance(document.get("apiVersion"), str) and isinstance(document.get("kind"), str)):
            continue
        for pod in _mappings(document, seen):
            for kind in CONTAINERS:
                held = pod.get(kind, [])
                if not isinstance(held, list):
                    yield 0, f"{kind} must be a list"
                    continue
                for i, container in enumerate(held):
                    if not isinstance(container, dict):
                        yield 0, f"{kind}[{i}] is not a container mapping"
                    elif not excepted(container):
                        contexts = [x for x in (pod.get("securityContext"), container.get("securityContext")) if isinstance(x, dict)]
                        rules = {k: v for x in contexts for k, v in x.items()}
                        user = rules.get("runAsUser")
                        if rules.get("runAsNonRoot") is not True or not (user is None or type(user) is int and user > 0):
                            name = container.get("name", f"{kind}[{i}]")
                            yield lines_of.get(id(container), 0) + 1, f"container '{name}' is not non-root"


def action_references(text: str) -> Iterator[Row]:
    """References at any depth of a workflow that aren't local and lack a full commit id."""
    import yaml

    try:
        documents = list(yaml.safe_load_all(text))
    except (yaml.YAMLError, RecursionError):
        yield 0, "malformed workflow YAML cannot be checked"
        return
    seen: set[int] = set()
    for value in (m for d in documents for m in _mappings(d, seen) if "uses" in m):
        used = value["uses"]
        if not isinstance(used, str):
            yield 0, "action reference must be text"
        elif not used.startswith("./") and not re.fullmatch(r"[^@\s]+@[0-9a-fA-F]{40}", used):
            yield 0, f"action '{used}' must use a full commit SHA"


def inferred_utf(content: bytes) -> str | None:
    """UTF-16 or 32 without a mark, told by how often each byte position of a unit is NUL."""
    share = [[content[i::w].count(0) / max(1, len(content[i::w])) for i in range(w)] for w in (2, 4)]
    two, four = share
    whole = lambda w: len(content) >= w and len(content) % w == 0
    tried = []
    if whole(4):
        tried += ["utf-32-le"] * (min(four[1:]) > 0.6 and four[0] < 0.2) + ["utf-32-be"] * (min(four[:3]) > 0.6 and four[3] < 0.2)
    if whole(2):
        tried += ["utf-16-le"] * (two[1] > 0.4 and two[0] < 0.2) + ["utf-16-be"] * (two[0] > 0.4 and two[1] < 0.2)
    for encoding in tried:
        try:
            content.decode(encoding)
        except UnicodeDecodeError:
            continue
        return encoding
    return None


_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def decode(content: bytes, mode: str = "conflict", hint: str | None = None, most: int | None = MAX_BYTES) -> tuple[str | None, str | None]:
    """Text and error. conflict: a mark, else the hint, else UTF-8, else null for a file with NUL, else Latin-1; of more than
    `most` bytes (None: no limit) an error instead. tree: a mark, else UTF-16 and 32 by their NULs, else UTF-8, else Latin-1."""
    if mode == "conflict" and most is not None and len(content) > most:
        return None, f"size ({len(content)} bytes) exceeds limit ({most} bytes)"
    marked = next((e for m, e in _MARKS if content.startswith(m)), None)
    strict = "strict" if mode == "tree" else "replace"
    tried = [(marked, strict)] if marked else []
    if not marked and mode == "tree":
        tried += [(inferred_utf(content), "strict"), ("utf-8", "strict")]
    elif not marked:
        tried += [(hint if hint != "unspecified" else None, "replace"), ("utf-8", "strict")]
    for encoding, errors in tried:
        try:
            if encoding:
                text = content.decode(encoding, errors)
                return text if encoding.startswith(("utf-16-", "utf-32-")) else text.lstrip("﻿"), None
        except (UnicodeDecodeError, LookupError):
            continue
    if mode == "conflict" and b"\x00" in content[:4096]:
        return None, None
    return content.decode("latin-1"), None
