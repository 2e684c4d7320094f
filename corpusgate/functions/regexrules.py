"""Hazards of backtracking in regular expressions, and the literals of JavaScript files.

A pattern is read once by a tokenizer made of one expression; groups lie on a stack. A group is a hazard if it repeats
without bound and holds a quantifier, or alternatives that begin alike. The innermost, leftmost hazard is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

NESTED = "nested quantifier"
OVERLAPPING = "overlapping alternation under a quantifier"
_TOKEN = re.compile(
    r"""(?P<escape>\\.|\\$)
    |(?P<set>\[\]?(?:\\.|[^\]\\])*\]?)
    |(?P<open>\((?:\?(?:P?<[A-Za-z_]\w*>|<=|<!|[:=!>]))?)
    |(?P<close>\))
    |(?P<bar>\|)
    |(?P<repeat>[*+]|\{\d*(?:,\d*)?\})
    |(?P<silent>[?^$])
    |(?P<atom>.)""",
    re.VERBOSE | re.DOTALL,
)
#: Where JavaScript has regular expressions.
JS_REGEXP = re.compile(r"new\s+RegExp\(\s*(?P<quote>['\"])(?P<body>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)")
JS_LITERAL = re.compile(r"(?:^|[=(,:!&|?{};])[ \t]*/(?![/*])(?P<body>(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*)/", re.MULTILINE)


def _bounds(quantifier: str) -> tuple[bool, bool]:
    """Whether it repeats more than once, and without bound."""
    if quantifier in ("*", "+"):
        return True, True
    low, comma, high = quantifier[1:-1].partition(",")
    if comma and not high:
        return True, True
    return int(high or low or 0) > 1, False


def hazard(pattern: str) -> str | None:
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(pattern)]
    stack: list[dict] = [{"quantified": False, "firsts": [None]}]

    def atom(text: str) -> None:
        if stack[-1]["firsts"][-1] is None:
            stack[-1]["firsts"][-1] = text

    for i, (kind, text) in enumerate(tokens):
        if kind == "open":
            stack.append({"quantified": False, "firsts": [None]})
        elif kind == "bar":
            stack[-1]["firsts"].append(None)
        elif kind == "repeat":
            if _bounds(text)[0]:
                stack[-1]["quantified"] = True
            elif text[0] == "{":
                atom("{")
        elif kind == "close":
            group = stack.pop() if len(stack) > 1 else {"quantified": False, "firsts": [None]}
            more, endless = _bounds(tokens[i + 1][1]) if i + 1 < len(tokens) and tokens[i + 1][0] == "repeat" else (False, False)
            firsts = [x for x in group["firsts"] if x]
            if endless and group["quantified"]:
                return NESTED
            if endless and len(set(firsts)) < len(firsts):
                return OVERLAPPING
            stack[-1]["quantified"] |= group["quantified"] or more
            atom("(group)")
        elif kind != "silent":
            atom(text)
    return None


def js_literals(text: str) -> Iterator[tuple[int, str]]:
    """Line and pattern of regular expressions in JavaScript: literals after an opening token, and RegExp strings."""
    for match in JS_LITERAL.finditer(text):
        if match["body"]:
            yield text.count("\n", 0, match.start("body")) + 1, match["body"]
    for match in JS_REGEXP.finditer(text):
        yield text.count("\n", 0, match.start("body")) + 1, match["body"].replace("\\\\", "\\")
