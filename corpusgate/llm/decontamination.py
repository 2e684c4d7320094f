"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of ASCII digits, ASCII letters (lower-cased) and everything above ASCII. Test strings are the windows
of WINDOW consecutive words of each benchmark item; an item with fewer words is one window. For test strings of one
length m, a shift table tells by the hash of a block of two words how far the search may move on: 0 if a test string
ends in the block, m - 1 if none holds it. Where it is 0, the exact block selects the test strings that end so, those
with another first word are passed over, and the rest are compared word by word.

All texts of a batch are searched side by side: each lane of LANE end positions makes its own jumps. Null texts have
no words and no hits; a null item_id is read as "". Items that repeat an id count once.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import materialised, shipped
from corpusgate.llm.wordhash import blocks, hashed_words, mixed, odd_numbers

WINDOW = 10
LANE = 256
#: Bytes of benchmark text that one pass over the documents searches for; more items take more passes.
PASS_BYTES = 4 << 20
_TABLE = 1 << 20
_BLOCK = odd_numbers(2, 7)


class Items:
    """The words of benchmark items: one run of bytes, where in it each word starts and ends, their hashes, each item's first word."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.names = sorted({name for name, _ in items}, key=lambda x: x.encode())
        place = {name: i for i, name in enumerate(self.names)}
        self.name = np.array([place[name] for name, _ in items], np.int64)
        self.hashes, self.offsets, (self.data, self.starts, self.ends) = hashed_words([text for _, text in items], spaced=False, places=True)

    def words(self, start: int, length: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[start : start + length], self.ends[start : start + length], strict=True)]


class TestStrings:
    """Shift table and suffix buckets for the test strings of one length, all in flat arrays.

    Equal test strings are one entry with the items that have it; starts are the first words of all test strings."""

    __test__ = False

    def __init__(self, items: Items, length: int, starts: np.ndarray, owners: np.ndarray) -> None:
        self.items, self.length, self.block = items, length, min(2, length)
        with np.errstate(over="ignore"):
            marks = [mixed(sum(items.hashes[starts + i] * f for i, f in enumerate(odd_numbers(length, seed)))) for seed in (8, 9)]
        order = np.lexsort((owners, *marks))
        new = np.ones(len(order), bool)
        new[1:] = (marks[0][order][1:] != marks[0][order][:-1]) | (marks[1][order][1:] != marks[1][order][:-1])
        first = np.flatnonzero(new)
        self.owners, self.owned = owners[order], np.append(first, len(order))
        self.starts = starts[order][first]
        at = self.starts[:, None] + np.arange(length)
        hashes = items.hashes[at]
        keys = self.keys(hashes.ravel()).reshape(-1, length)
        self.shifts = np.full(_TABLE, length - self.block + 1, np.int32)
        for j in range(length - self.block + 1):  # the block that ends at word j + block - 1
            end = j + self.block - 1
            np.minimum.at(self.shifts, keys[:, end] % np.uint64(_TABLE), length - 1 - end)
        self.order = np.argsort(keys[:, -1], kind="stable")
        self.suffixes, self.first = keys[self.order, -1], hashes[self.order, 0]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each word."""
        with np.errstate(over="ignore"):
            if self.block == 1:
                return mixed(words * _BLOCK[1])
            return mixed(words * _BLOCK[1] + np.concatenate([words[:1], words[:-1]]) * _BLOCK[0])

    def ends(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions where a test string may end: the search jumps by the shift table, in lanes."""
        first, last = offsets[:-1] + self.length - 1, offsets[1:]
        lanes = np.maximum(0, -(-(last - first) // LANE))
        text = np.repeat(np.arange(len(first)), lanes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[text] + step * LANE
        stop = np.minimum(at + LANE, last[text])
        found = []
        while len(at):
            shift = self.shifts[keys[at] % np.uint64(_TABLE)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, words: np.ndarray, offsets: np.ndarray, at_word) -> Iterator[tuple[int, np.ndarray]]:
        """First word and items (places in names) of each occurrence. at_word gives the bytes of words a to b."""
        if not len(words):
            return
        keys = self.keys(words)
        ends = self.ends(keys, offsets)
        low = np.searchsorted(self.suffixes, keys[ends], "left")
        high = np.searchsorted(self.suffixes, keys[ends], "right")
        for end, a, b in zip(ends[low < high], low[low < high], high[low < high], strict=True):
            start = end - self.length + 1
            same = np.flatnonzero(self.first[a:b] == words[start])
            if len(same):
                here = at_word(start, end + 1)
                for i in self.order[a + same]:
                    if self.items.words(self.starts[i], self.length) == here:
                        yield start, self.owners[self.owned[i] : self.owned[i + 1]]


def test_strings(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[Items, list[TestStrings]]:
    read = Items(items)
    sizes = np.diff(read.offsets)
    lengths = np.minimum(sizes, window)
    parts = []
    for length in np.unique(lengths[lengths > 0]):
        of = np.flatnonzero(lengths == length)
        n = sizes[of] - length + 1
        starts = np.repeat(read.offsets[:-1][of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append(TestStrings(read, int(length), starts, np.repeat(read.name[of], n)))
    return read, parts


test_strings.__test__ = False
#: The tables of the last pass that this worker searched for, and its number.
_built: dict[str, tuple[Items, list[TestStrings]]] = {}


def _tables(number: str, content: list[tuple[str, bytes]], window: int) -> tuple[Items, list[TestStrings]]:
    """Built once in each worker, which serves many tasks."""
    if number not in _built:
        _built.clear()
        _built[number] = test_strings(content, window)
    return _built[number]


def _searched(names: list[str], parts: list[TestStrings], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Number of words of each text, a mark for each hit word, the items found in each text with any."""
    words, offsets, bounds = hashed_words(texts, spaced=False, places=True)
    data, starts, ends = bounds
    edges = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for part in parts:
        for start, found in part.search(words, offsets, lambda a, b: [data[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)]):
            edges[start] += 1
            edges[start + part.length] -= 1
            items[int(np.searchsorted(offsets, start, "right")) - 1].update(names[k] for k in found)
    return offsets, np.cumsum(edges[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with n_words, hits (array<struct<start, end>>: runs of hit words) and items (item_ids, sorted).

    The benchmark is the stated set of things to look for. It passes through the driver PASS_BYTES bytes at a time, each of
    which is a pass over the documents; what one pass found is written before the next, so that a task holds the tables of one,
    some 60 times its bytes while it builds them. Columns of docs by these names are replaced."""
    names = ("n_words", "hits", "items")
    rows = shipped(docs).select("*").drop(*names).withColumn("n_words", F.lit(0).cast("bigint"))
    rows = rows.withColumn("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")).withColumn("items", F.array().cast("array<string>"))
    schema = rows.schema
    text_at = rows.columns.index("text")

    def searching(content, number: str):
        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, parts = _tables(number, content.value, window)
            for batch in batches:
                for first, texts in blocks(batch.column(text_at).cast(pa.string())):
                    offsets, marks, items = _searched(read.names, parts, texts)
                    part = batch.slice(first, len(texts))
                    before = dict(zip(names, (part.column(part.schema.get_field_index(n)) for n in names), strict=True))
                    hits, found = [], []
                    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                        mark, old = marks[a:b], before["hits"][i].as_py()
                        if (i not in items) and not old:
                            hits.append([])
                            found.append(before["items"][i].as_py())
                            continue
                        mark = mark.copy()
                        for x in old:
                            mark[x["start"] : x["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                        hits.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2], strict=True)])
                        found.append(sorted({*before["items"][i].as_py(), *items.get(i, ())}, key=lambda x: x.encode()))
                    columns = [part.column(i) for i in range(part.num_columns)]
                    for name, values in (("n_words", np.diff(offsets)), ("hits", hits), ("items", found)):
                        i = part.schema.get_field_index(name)
                        columns[i] = pa.array(values, part.schema.field(i).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

        return searched

    before = None
    for content in _passes(benchmark):
        if before is not None:
            rows = materialised(before, "decontamination")
        before = rows.mapInArrow(searching(content, uuid.uuid4().hex), schema)
    return before


def _passes(benchmark: DataFrame) -> Iterator:
    """Broadcasts of the items, PASS_BYTES at a time; one empty pass if there are none."""
    context = benchmark.sparkSession.sparkContext
    held, size, sent = [], 0, 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    for item, text in items.toLocalIterator():
        if held and size + len(text) > PASS_BYTES:
            yield context.broadcast(held)
            held, size, sent = [], 0, sent + 1
        held.append((item, bytes(text)))
        size += len(text)
    if held or not sent:
        yield context.broadcast(held)


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    hit = hit_words(F.col("hits"))
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
