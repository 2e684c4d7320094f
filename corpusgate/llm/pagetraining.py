"""Labelled pages to train on: layouts of many kinds, made from a seed. data-y tells whether an element is content."""

from __future__ import annotations

import random
from html import escape

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo za tion ment er ing".split()
NAMES = {
    "content": ["content", "article", "post", "entry-content", "article-body", "post-content", "story", "main-content", "body-text", "text", ""],
    "menu": ["nav", "menu", "navbar", "main-menu", "topnav", "navigation", "breadcrumb", "breadcrumbs", "links", "pagination", "toc", ""],
    "header": ["header", "site-header", "masthead", "top", "branding", "page-header", "logo", ""],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", ""],
    "sidebar": ["sidebar", "side", "aside", "widget", "related", "widget-area", "recommended", "popular", "right-column", "left-column"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "promotion", "sponsor"],
    "notice": ["notice", "cookie", "cookie-notice", "alert", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "message", "warning"],
    "comments": ["comments", "comment-list", "comment", "responses", "discussion", "replies", "reader-comments", "reply"],
    "share": ["share", "social", "share-buttons", "tools", "meta", "byline-links", "tags"],
    "layout": ["container", "wrapper", "row", "col", "inner", "page", "grid", "block", "box", "main", "center", "section", "", "", "", ""],
}
TAGS = {
    "menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
    "ad": ["div", "aside", "section", "p"], "notice": ["div", "section", "p", "aside"], "comments": ["section", "div", "ol"], "share": ["div", "ul", "p"],
}


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.odd = False
        self.body_y = 0  # the label of a body that no tag opens

    def words(self, n: int) -> str:
        r = self.r
        if self.odd and n > 3:  # junk, lists of names and the like: one word again and again, no sentences
            word = "".join(r.choices(SYLLABLES, k=3)) + r.choice(["", "", ",", ".", "###"])
            return " ".join([word] * n if r.random() < 0.5 else r.choices(SYLLABLES, k=n))
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(n)]
        for i in range(r.randint(5, 12), n, r.randint(6, 14)):
            out[i - 1] = out[i - 1].rstrip(",") + "."
        return escape(" ".join(out).capitalize()) + (r.choice([".", ".", ".", "!", ""]) if n > 3 else "")

    def named(self, kind: str) -> str:
        name = self.r.choice(NAMES[kind])
        if not name or self.r.random() < 0.15:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def el(self, tag: str, y: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-y="{y}">{inner}</{tag}>'

    def link(self, n: int = 2) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(self.r.randint(1, n))}</a>'

    def links(self, y: int = 0) -> str:
        items = "".join(self.el("li", y, self.link(3)) for _ in range(self.r.randint(2, 9)))
        return self.el(self.r.choice(["ul", "ul", "ol"]), y, items)

    def boiler(self, kind: str, inside: bool = False) -> str:
        """A part that isn't content; inside of content its name tells so, as a list of links without one belongs to it."""
        r = self.r
        tag = r.choice(TAGS[kind])
        text = {
            "menu": lambda: self.links() if tag != "ul" else "".join(self.el("li", 0, self.link()) for _ in range(r.randint(2, 8))),
            "header": lambda: r.choice([self.link(), self.el("h1", 0, self.link()), self.el("div", 0, self.words(3)) + self.links(), self.words(4)]),
            "footer": lambda: r.choice(["&copy; ", ""]) + self.words(r.randint(2, 16)) + r.choice(["", self.links(), " | " + self.link()]),
            "sidebar": lambda: self.el("h3", 0, self.words(2)) + r.choice([self.links(), self.el("p", 0, self.words(r.randint(5, 40)))]),
            "ad": lambda: r.choice([self.words(r.randint(3, 25)), self.link(8), self.el("p", 0, self.words(r.randint(4, 25)))] if tag != "p" else [self.words(8)]),
            "notice": lambda: self.words(r.randint(6, 35)) + r.choice(["", " " + self.link()]),
            "comments": lambda: ("" if tag == "ol" else self.el("h3", 0, self.words(2)))
            + "".join(
                self.el("li" if tag == "ol" else "div", 0, self.el("p", 0, self.words(r.randint(3, 60))), r.choice(["", ' class="comment"']))
                for _ in range(r.randint(1, 5))
            ),
            "share": lambda: " ".join(self.link(1) for _ in range(r.randint(2, 5))) if tag != "ul" else self.el("li", 0, self.link(1)),
        }[kind]()
        attrs = self.named(kind)
        if tag in ("div", "section", "p", "ol", "ul") and not attrs and (inside or kind not in ("menu", "share")):
            attrs = f' class="{r.choice([n for n in NAMES[kind] if n])}"'
        return self.el(tag, 0, text, attrs)

    def form(self) -> str:
        attrs = self.r.choice(["", ' class="search"', ' id="login"', ' class="signup"'])
        return self.el("form", 0, f"<label>{self.words(2)}</label><input name=q> {self.words(self.r.randint(1, 12))}<button>Go</button>", attrs)

    def article(self, depth: int) -> str:
        r = self.r
        out = [self.el(r.choice(["h1", "h1", "h2"]), 1, self.words(r.randint(2, 10)))] if r.random() < 0.9 else []
        odd = r.choice([0, 0, 0, 0.3, 1])
        many = r.random() < 0.08  # a long run of short paragraphs, as in verse or dialogue
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]) * (12 if many else 1)):
            kind = r.random()
            n = r.choice([1, 1, 2, 3] if many else [1, 2, 4, 8, 20, 40, 80, 200, 1500])
            self.odd = r.random() < odd
            if kind < 0.75:
                text = self.words(n)
                out.append(self.el("p", 1, r.choice([text, text, f"<b>{text}</b>", text + " " + self.link() + " " + self.words(4)])))
            elif kind < 0.8:
                out.append(self.el("h2", 1, self.words(3)))
            elif kind < 0.87:
                out.append(self.listed(n))
            elif kind < 0.89:
                out.append(self.el("blockquote", 1, self.el("p", 1, self.words(n))))
            elif kind < 0.91:
                out.append(self.table())
            elif kind < 0.92:
                out.append(self.el("pre", 1, self.words(6)))
            elif kind < 0.95:
                out.append(self.el("div", 1, self.words(n)))
            elif kind < 0.975:
                out.append(self.boiler(r.choice(["ad", "ad", "share", "notice"]), True))
            else:
                out.append(self.el("figure", 1, self.el("figcaption", 1, self.words(6))))
        self.odd = False
        if r.random() < 0.1:
            out.append(self.boiler("comments", True))
        if r.random() < 0.08:
            out.append(self.words(12))
        if r.random() < 0.3:
            out = self.grouped(out)
        if r.random() < 0.15 and out[0].startswith("<h"):
            about = r.choice(["", "", self.el("p", 1, self.words(r.randint(2, 14))), self.el("div", 1, self.words(3), self.named("share")), self.boiler("share", True)])
            out[0] = self.el("header", 1, out[0] + about, r.choice(["", "", ' class="entry-header"', ' class="article-header"']))
        inner = "".join(out)
        tag = r.choice(["article", "article", "article", "main", "main", "div", "div", "section"])
        attrs = self.named("content")
        if tag in ("div", "section") and not attrs and r.random() < 0.5:
            attrs = f' class="{r.choice([n for n in NAMES["content"] if n])}"'
        inner = self.el(tag, 1, inner, attrs)
        while depth and r.random() < 0.35:
            beside = self.boiler(r.choice(["sidebar", "comments", "ad", "share"])) if r.random() < 0.3 else ""
            inner = self.el(r.choice(["main", "div", "div"]), int(not beside), inner + beside, self.named("layout"))
            depth -= r.random() < 0.5
        return inner

    def listed(self, n: int) -> str:
        """A list inside of content, some of links, of long items or of terms."""
        r = self.r
        kind, items = r.random(), r.choice([2, 3, 4, 4, 7, 12])
        if kind < 0.15:
            return self.el("dl", 1, "".join(self.el("dt", 1, self.words(r.randint(1, 3))) + self.el("dd", 1, self.words(r.randint(2, 20))) for _ in range(items)))
        item = {
            0: lambda: self.words(r.randint(1, 14)), 1: lambda: self.words(min(n, 80)), 2: lambda: self.el("p", 1, self.words(r.randint(2, 30))),
            3: lambda: self.link(6), 4: lambda: self.words(r.randint(3, 12)) + " " + self.link(4),
        }[r.choice([0, 0, 0, 1, 2, 3, 4])]
        return self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, item()) for _ in range(items)))

    def table(self) -> str:
        r = self.r
        width, rows = r.randint(2, 4), r.randint(1, 6)
        cells = lambda tag: self.el("tr", 1, "".join(self.el(tag, 1, self.words(r.randint(1, 4))) for _ in range(width)))
        body = "".join(cells("td") for _ in range(rows))
        if r.random() < 0.5:
            return self.el("table", 1, (cells("th") if r.random() < 0.5 else "") + body)
        return self.el("table", 1, self.el("thead", 1, cells("th")) + self.el("tbody", 1, body))

    def grouped(self, parts: list[str]) -> list[str]:
        """Parts of content in sections or containers, some of them with a heading, or one in another."""
        r = self.r
        out, at = [], 1 if r.random() < 0.6 else 0
        out += parts[:at]
        tag = r.choice(["section", "section", "div"])
        while at < len(parts):
            n = r.randint(1, 4)
            head = self.el(r.choice(["h2", "h2", "h3"]), 1, self.words(r.randint(1, 5))) if r.random() < 0.6 else ""
            inner = head + "".join(parts[at : at + n])
            for _ in range(r.choice([1, 1, 1, 2])):
                inner = self.el(tag, 1, inner, self.named(r.choice(["layout", "layout", "content"])) if r.random() < 0.5 else "")
            out.append(inner)
            at += n
        return out or [self.el("p", 1, self.words(20))]

    def html(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("header", "menu", "notice", "ad") if r.random() < 0.6] + ([self.form()] if r.random() < 0.25 else [])
        after = [self.boiler(k) for k in ("sidebar", "comments", "share", "ad", "notice", "menu", "footer") if r.random() < 0.45]
        after += [self.form()] if r.random() < 0.25 else []
        if r.random() < 0.2:
            self.body_y, parts = 1, [self.el("h1", 1, self.words(4)), *[self.el("p", 1, self.words(r.randint(3, 80))) for _ in range(r.randint(1, 8))]]
            for _ in range(r.choice([0, 0, 1, 3])):
                parts.insert(r.randint(0, len(parts)), self.words(r.choice([1, 2, 5, 15, 60])) + r.choice(["", "<br>"]))
            bare = r.random() < 0.25
            if bare:  # text and next to no markup
                before, after, parts = [], [], [self.words(r.choice([1, 2, 5, 30, 200])), *parts[: r.choice([0, 0, 1])]]
        else:
            bare, parts = False, [self.article(1)]
        if r.random() < 0.3:
            r.shuffle(before)
        body = "".join([*before, *parts, *after])
        if r.random() < (0.6 if bare else 0.1):
            return body
        head = f"<head><title>{self.words(5)}</title><style>a{{b:c}}</style>" + r.choice(["</head>", "</head>", ""])
        return f'<!DOCTYPE html><html data-y="0">{head}<body data-y="{self.body_y}">{body}</body></html>'
