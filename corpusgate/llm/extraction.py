"""Main text of web pages by a graphical model over the page's tree.

Every block element, and every inline one with a class, id or role, is a variable: content or not. Its own potential
comes from its names, how much text and how many links it holds, and how much text stands beside it in its parent; a potential for each edge tells how
parents and children of each tag go together. Both are smoothed counts over labelled pages: pages made from seeds, and a
bounded sample of the table's own pages that have one article element, which labels them. Sum-product messages go from the leaves up and
from the root down, which gives the exact marginal of every element; the text of those above one half, outside of what
a page never shows, is the page's text, in page order.

Blocks are joined by line feeds; white space inside a block, a line break included, is one space. A null page counts
as empty and gives an empty text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import shipped
from corpusgate.llm.dom import Node, Tree, joined
from corpusgate.llm.pagetraining import NAMES, Page

#: Pages to train on that are made from seeds.
MADE = 2000
#: Pages of the table to train on, about, at most; a hash of page_id chooses them.
SAMPLE = 1000
#: Elements and names inside an article that may be something else than content.
OTHER_TAGS = frozenset("nav aside form footer".split())
OTHER_NAMES = frozenset(word for kind, names in NAMES.items() if kind != "content" for name in names for word in name.split("-") if word)
SMOOTHING = 0.5
#: Weight of the text's features, which depend on each other.
TEXT_WEIGHT = 0.5
_TEXT = ("own", "chars", "linked", "stops", "paragraphs", "kin")


class Model(NamedTuple):
    """Log odds of content by feature; by the child's tag edges[tag][parent][child], the probability of the child's
    label given the parent's, "" for other tags; root[tag] is the probability of each label without a parent."""

    odds: dict[str, float]
    edges: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: dict[str, tuple[float, float]]


def features(node: Node) -> list[str]:
    share = node.linked / node.chars if node.chars else 0.0
    linked = int(share > 0.5)
    return [
        *[f"name {x}" for x in node.tokens],
        f"paragraphs {min(8, node.paragraphs).bit_length()}",
        f"own {node.tag} {min(node.own, 4000).bit_length() // 2} {linked}",
        f"chars {min(node.chars, 20000).bit_length() // 2} {linked}",
        f"linked {node.tag} {math.ceil(share * 4)}",
        f"kin {node.tag} {min(node.kin, 4000).bit_length() // 3} {linked}",
        f"stops {min(3, node.stops) if node.chars < 400 else 4 if node.stops * 60 > node.chars else 5}",
    ]


def counts(nodes: list[Node]) -> Counter:
    """What one labelled page adds: features and edges with their labels."""
    found: Counter = Counter()
    for node in nodes[1:]:
        if node.label is None:
            continue
        found.update((f, node.label) for f in features(node))
        found["all", node.label] += 1
        up = nodes[node.parent].label
        found["root" if up is None else f"edge {up}", node.label] += 1
        found[f"root {node.tag}" if up is None else f"edge {up} {node.tag}", node.label] += 1
    return found


def structure_labels(nodes: list[Node]) -> None:
    """Labels of a user's page by its structure: what its one article holds is content, but for parts that are named as
    something else, which are left open; what lies outside of it isn't. Other pages get no labels."""
    if sum(x.tag == "article" for x in nodes) != 1:
        return
    inside, other = [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.tag == "article"
        other[i] = other[node.parent] or inside[node.parent] and (node.tag in OTHER_TAGS or not OTHER_NAMES.isdisjoint(node.tokens))
        node.label = None if other[i] else int(inside[i])


def train(spark: SparkSession, made: int = MADE, pages: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Counts over `made` pages from seeds, and about `sample` at most of `pages` (columns page_id, html), labelled by their structure.

    Pages are parsed by the executors; what comes back is a row for each feature and label."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for seed, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if seed is None:
                    nodes = Tree(html.as_py()).nodes
                    structure_labels(nodes)
                else:
                    page = Page(seed)
                    nodes = Tree(page.html(), labelled=True, implied=page.body_y).nodes
                total.update(counts(nodes))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())],
            ["feature", "label", "n"],
        )

    rows = spark.range(0, made, 1, 4).select("id", F.lit(None).cast("string").alias("html"))
    if pages is not None:
        share = int(1_000_000 * min(1.0, sample / max(1, pages.count())))
        chosen = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < share
        rows = rows.unionByName(pages.filter(chosen & F.col("html").contains("<article")).select(F.lit(None).cast("bigint").alias("id"), F.col("html").cast("string")))
    rows = shipped(rows).mapInArrow(counted, "feature string, label bigint, n bigint")
    n = {(r.feature, r.label): r.n for r in rows.groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()}
    return fitted(n)


def fitted(n: dict[tuple[str, int], int]) -> Model:
    all_0, all_1 = n.get(("all", 0), 0) + 1, n.get(("all", 1), 0) + 1
    odds = {}
    for name in {f for f, _ in n if not f.startswith(("edge", "root", "all"))}:
        a, b = n.get((name, 0), 0) + SMOOTHING, n.get((name, 1), 0) + SMOOTHING
        odds[name] = math.log(b / all_1) - math.log(a / all_0)
        if name.split(" ")[0] in _TEXT:
            odds[name] *= TEXT_WEIGHT

    def pair(name: str, prior: tuple[float, float] = (0.5, 0.5)) -> tuple[float, float]:
        a, b = n.get((name, 0), 0) + 4 * prior[0], n.get((name, 1), 0) + 4 * prior[1]
        return a / (a + b), b / (a + b)

    edges = {"": (pair("edge 0"), pair("edge 1"))}
    for tag in {f.split(" ")[2] for f, _ in n if f.startswith("edge") and f.count(" ") == 2}:
        edges[tag] = (pair(f"edge 0 {tag}", edges[""][0]), pair(f"edge 1 {tag}", edges[""][1]))
    root = {"": pair("root")}
    root |= {tag: pair(f"root {tag}", root[""]) for tag in {f.split(" ")[1] for f, _ in n if f.startswith("root ")}}
    return Model(odds, edges, root)


def marginals(model: Model, nodes: list[Node]) -> list[float]:
    """The probability of content of each node, node 0 being above the page's root and without text.

    The edge potential is the probability of the child's label given the parent's; messages are kept as log odds."""
    odds = model.odds
    edges = [model.edges.get(x.tag, model.edges[""]) for x in nodes]
    n = len(nodes)
    own = [0.0] * n
    for i in range(1, n):
        own[i] = sum(odds.get(f, 0.0) for f in features(nodes[i]))
    up = [0.0] * n  # log odds that a node's message adds to its parent
    inside = own[:]
    for i in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edges[i]
        x = math.exp(max(-50.0, min(50.0, inside[i])))
        up[i] = math.log((e10 + e11 * x) / (e00 + e01 * x))
        inside[nodes[i].parent] += up[i]
    belief = [0.0] * n
    for i in range(1, n):
        p = nodes[i].parent
        if p == 0:
            root = model.root.get(nodes[i].tag, model.root[""])
            belief[i] = inside[i] + math.log(root[1] / root[0])
            continue
        (e00, e01), (e10, e11) = edges[i]
        y = math.exp(max(-50.0, min(50.0, belief[p] - up[i])))  # the parent without this child's message
        belief[i] = inside[i] + math.log((e01 + e11 * y) / (e00 + e10 * y))
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]


def main_text(model: Model, html: str) -> str:
    tree = Tree(html)
    keep = [x > 0.5 for x in marginals(model, tree.nodes)]
    if not tree.elements:  # nothing but text
        keep = [True] * len(keep)
    return joined(tree.texts, keep)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """The rows of pages with text and n_chars in place of html; columns of pages by these names are replaced."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(sent.value, x.as_py() or "") for x in batch.column(len(others))]
            columns = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*others, "text"])

    rows = shipped(pages).select(*others, F.col(html).cast("string").alias("text"))
    found = rows.mapInArrow(extracted, rows.schema)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    return extract(pages.select("page_id", "url", "html"), train(pages.sparkSession, pages=pages))
