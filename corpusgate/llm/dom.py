"""A page as a tree: elements with the text and the counts that features need.

Tags are read leniently and each in bounded time, whatever is open: where an element stands that a tag ends is known by its name."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

#: Elements by how a page is laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template head title svg annotation iframe object canvas audio video button select textarea datalist xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded msub msup msubsup munder mover munderover".split()
)
IN_HEAD = frozenset("head base link meta style script noscript template title".split())
#: Open elements that a start tag ends, by start tag, and by open element what it can't be ended across.
_BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
)
ENDS = {tag: ("p",) for tag in _BLOCKS.split()} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "body": ("head",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th"), "tfoot": ("tr", "td", "th"),
}
_SCOPE = {
    "p": frozenset("table td th caption button object".split()), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
    "option": frozenset(["select", "datalist"]), "head": frozenset(), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]),
}
_TOKENS = re.compile(r"[a-z]+")


class Node:
    """An element that has a variable: blocks, and inline elements with a class, id or role."""

    __slots__ = ("tag", "parent", "tokens", "label", "own", "chars", "linked", "stops", "paragraphs", "kin")

    def __init__(self, tag: str, parent: int, tokens: tuple[str, ...], label: int | None) -> None:
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.own = self.chars = self.linked = self.stops = self.paragraphs = self.kin = 0


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?|=)""")
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())


def read(html: str, start, end, data) -> None:
    """Calls start(tag, attributes), end(tag) and data(text) in order, in time linear in the page's length.

    Comments, declarations, processing instructions and marked sections call nothing. What looks like the beginning of one or
    of a tag, and has no end, is text."""
    missing: set[str] = set()  # what isn't found any more in the rest of the page
    size, at = len(html), 0

    def find(what: str, place: int) -> int:
        found = -1 if what in missing else html.find(what, place)
        if found < 0:
            missing.add(what)
        return found

    def text(a: int, b: int) -> None:
        if a < b:
            data(unescape(html[a:b]))

    while at < size:
        here = find("<", at)
        if here < 0:
            return text(at, size)
        text(at, here)
        closing = html.startswith("/", here + 1)
        name = _NAME.match(html, here + 1 + closing)
        if name is None:
            stop = -1
            if html.startswith("<!--", here) and not html.startswith(("<!-->", "<!--->"), here):
                stop = find("-->", here + 4) + 2
            if stop < 2 and (closing or html.startswith(("<!", "<?"), here)):
                stop = find(">", here)
            if stop < 0:
                data("<")
                at = here + 1
            else:
                at = stop + 1
            continue
        if find(">", here) < 0:
            return text(here, size)
        attrs: dict[str, str] = {}
        at = name.end()
        while pair := _ATTRIBUTE.match(html, at):
            at = pair.end()
            if pair[1]:
                value = pair[2] or ""
                value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
                attrs.setdefault(pair[1].lower(), unescape(value) if "&" in value else value)
        at = find(">", at) + 1 or size
        tag = name[0].lower()
        if closing:
            end(tag)
            continue
        start(tag, attrs)
        if tag in RAW and f"</{tag}" not in missing:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            if stop:
                data(html[at : stop.start()])
                at = stop.start()
            else:
                missing.add(f"</{tag}")
                at = size if tag in ("script", "style") else at


class Tree:
    """nodes in page order, parents first; texts are (node, block, text), block being a number that changes at each block's edge.

    Text and elements that stand outside of html or body belong to a body that is made for them. labelled: data-y of an
    element is its label, and `implied` that of such a body; else attributes of that name mean nothing."""

    def __init__(self, html: str, labelled: bool = False, implied: int | None = None) -> None:
        self.nodes = [Node("#page", -1, (), None)]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.elements = 0
        self._labelled, self._implied = labelled, implied
        self._open: list[tuple[str, int]] = [("#page", 0)]  # tag, nearest node
        self._at: dict[str, list[int]] = defaultdict(list)  # where in _open each tag stands
        self._blocks = [0]  # where in _open tags stand that aren't inline
        self._hidden = 0
        self._links = 0
        read(html, self.start, self.end, self.data)
        for node in reversed(self.nodes[1:]):
            up = self.nodes[node.parent]
            up.chars, up.linked, up.stops = up.chars + node.chars, up.linked + node.linked, up.stops + node.stops
            up.paragraphs += node.tag == "p"
        for node in self.nodes[1:]:
            up = self.nodes[node.parent]
            node.kin = 0 if up.tag in ("#page", "html", "body") else up.chars - up.linked - node.chars + node.linked

    def _close(self, upto: int) -> None:
        """Closes what is open from that place on."""
        while len(self._open) > upto:
            tag, _ = self._open.pop()
            self._at[tag].pop()
            self._hidden -= tag in HIDDEN
            self._links -= tag == "a"
            if tag not in INLINE:
                self._blocks.pop()
                self.block += 1

    def _last(self, tags: frozenset[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=0)

    def _end_by(self, tag: str) -> None:
        """Closes the outermost open element that this start tag ends."""
        ends = [self._at[k][-1] for k in ENDS.get(tag, ()) if self._at[k] and self._at[k][-1] > self._last(_SCOPE[k])]
        if ends:
            self._close(min(ends))
        if self._at["head"] and self._hidden == 1 and tag not in IN_HEAD:
            self._close(self._at["head"][-1])

    def _near(self) -> int:
        """The nearest node; a body is made, once, where that is none or html."""
        near = self._open[-1][1]
        if self.nodes[near].tag in ("#page", "html"):
            self.nodes.append(Node("body", near, (), self._implied))
            body = len(self.nodes) - 1
            self._open = [(tag, body if of == near else of) for tag, of in self._open]
            near = body
        return near

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self._at[tag]:
            return
        self.elements += 1
        self._end_by(tag)
        if tag not in INLINE:
            self.block += 1
        near = self._open[-1][1] if self._hidden or tag in ("html", "head", "body") or tag in HIDDEN or tag in IN_HEAD else self._near()
        if tag == "br":
            self._add(near, " ")
        if tag in VOID:
            return
        named = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
        if (tag not in INLINE or named.strip()) and tag not in HIDDEN and not self._hidden:
            tokens = tuple(dict.fromkeys(_TOKENS.findall(named.lower()))) if named.strip() else ()
            if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
                tokens += ("hidden",)
            self.nodes.append(Node(tag, near, tokens, int(attrs["data-y"]) if self._labelled and "data-y" in attrs else None))
            near = len(self.nodes) - 1
        self._at[tag].append(len(self._open))
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append((tag, near))
        self._hidden += tag in HIDDEN
        self._links += tag == "a"

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if self._at[tag] and (tag not in INLINE or self._at[tag][-1] > self._blocks[-1]):
            self._close(self._at[tag][-1])

    def _add(self, near: int, data: str) -> None:
        if not self._hidden:
            self.texts.append((near, self.block, data))

    def data(self, data: str) -> None:
        if self._hidden == 1 and self._open[-1][0] == "head" and data.strip():
            self._close(self._at["head"][-1])
        if self._hidden:
            return
        near = self._near() if data.strip() else self._open[-1][1]
        n = len(data) - data.count(" ")
        self.texts.append((near, self.block, data))
        if n:
            node = self.nodes[near]
            node.own += n
            node.chars += n
            node.stops += data.count(".") + data.count(",")
            if self._links:
                node.linked += n


def joined(texts: list[tuple[int, int, str]], keep: list[bool]) -> str:
    """The texts of kept nodes: blocks by line feeds, white space inside a block as one space."""
    out: list[str] = []
    run: list[str] = []
    at = None
    for node, block, data in texts:
        if not keep[node]:
            continue
        if block != at:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run, at = [], block
        run.append(data)
    if line := " ".join("".join(run).split()):
        out.append(line)
    return "\n".join(out)
