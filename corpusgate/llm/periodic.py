"""Periodic runs of the words of a text, by the runs theorem.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of at least max(SHORTEST, LEAST * q) words are told.
The period of every run is the length of a longest Lyndon word, in the order of words or in the opposite one, that begins in it. Such a word ends
where the next smaller value of the inverse suffix array stands (for the opposite order: the next greater). Each of these roots is extended both
ways by longest common prefixes, as minima over the LCP array from a sparse table, of the words and of the words reversed.

A run holds each of its words three times or more, so words that a stretch holds less often part it first; stretches shorter than SHORTEST have no
run, and the others of many texts are worked at in one array, parted by numbers of their own. That leaves out no run. A null text has no words and
no runs; repeated rows are told apart by nothing and get the same result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import SPACED, shipped

SHORTEST = 24
LEAST = 3
#: Words of stretches that are worked at together, or one longer stretch.
BLOCK_WORDS = 1 << 17
_WORD = re.compile(SPACED)
Run = tuple[int, int, int]


def stretches(ids: list[int], shortest: int = SHORTEST, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of a text, as begin and end, that may hold a run: every word is in them `least` times at least."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        if end - begin < shortest:
            continue
        part = ids[begin:end]
        times = Counter(part)
        rare = {w for w, n in times.items() if n < least}
        if not rare:
            out.append((begin, end))
            continue
        last = begin
        for i, w in enumerate(part, begin):
            if w in rare:
                if i - last >= shortest:
                    todo.append((last, i))
                last = i + 1
        if end - last >= shortest:
            todo.append((last, end))
    return sorted(out)


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the place of each, by doubling the length by which they are sorted; a prefix comes first."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: max(n - step, 0)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32), rank.astype(np.int32)
        step *= 2


def common_prefixes(values: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in order, in the order of the text: it falls by one at most from place to place."""
    v, before, n = values.tolist(), [-1] * len(values), len(values)
    for one, other in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
        before[one] = other
    out = [0] * n
    length = 0
    for i, j in enumerate(before):
        if j < 0:
            length = 0
            continue
        last = n - max(i, j)
        while length < last and v[i + length] == v[j + length]:
            length += 1
        out[i] = length
        length -= length > 0
    lcp = np.zeros(n, np.int32)
    lcp[place] = out
    return lcp


class Extensions:
    """Lengths of the longest common prefixes of pairs of suffixes, each by two reads of a sparse table of minima."""

    def __init__(self, values: np.ndarray) -> None:
        order, self.place = suffix_array(values)
        self.levels = [common_prefixes(values, order, self.place)]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lengths(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        a, b = self.place[one], self.place[other]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(one), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def next_beyond(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next place with a smaller value and the next with a greater one, the length where there is none; values differ."""
    n = len(values)
    lower, upper = [n] * n, [n] * n
    rising: list[int] = []
    falling: list[int] = []
    v = values.tolist()
    for i, x in enumerate(v):
        while rising and v[rising[-1]] > x:
            lower[rising.pop()] = i
        while falling and v[falling[-1]] < x:
            upper[falling.pop()] = i
        rising.append(i)
        falling.append(i)
    return np.array(lower), np.array(upper)


def runs_of(values: np.ndarray, shortest: int = SHORTEST, least: int = LEAST) -> np.ndarray:
    """Rows of begin, end and period of the runs. Numbers that part texts must be unique, and smaller than all others; the last value is one."""
    n = len(values)
    forward = Extensions(values)
    lower, upper = next_beyond(forward.place)
    at = np.concatenate([np.arange(n)] * 2)
    period = np.concatenate([lower, upper]) - at
    kept = at + period < n
    at, period = at[kept], period[kept]
    right = forward.lengths(at, at + period)
    del forward
    # A run goes on to the right of its last root by less than a period, and to the left of its first one: shorter ones drop out here.
    kept = right + 2 * period >= shortest
    at, period, right = at[kept], period[kept], right[kept]
    backward = Extensions(values[::-1])
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    left[inner] = backward.lengths(n - at[inner], n - at[inner] - period[inner])
    begin, end = at - left, at + period + right
    kept = end - begin >= np.maximum(shortest, least * period)
    rows = np.stack([begin[kept], end[kept], period[kept]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The same stretch with a multiple of its period is no run of its own.
    return rows[np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(1)])]


def runs_of_texts(texts: list[list[int]], shortest: int = SHORTEST, least: int = LEAST, block: int = BLOCK_WORDS) -> list[list[Run]]:
    """start, length and period of the runs of each text, by start, then period; a text is a list of numbers of its words."""
    out: list[list[Run]] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []

    def work() -> None:
        total = sum(end - begin + 1 for _, begin, end in held)
        values = np.empty(total, np.int64)
        starts = np.zeros(len(held), np.int64)
        at = 0
        for k, (text, begin, end) in enumerate(held):
            starts[k] = at
            values[at : at + end - begin] = texts[text][begin:end]
            values[at + end - begin] = -1 - k
            at += end - begin + 1
        for begin, end, period in runs_of(values, shortest, least).tolist():
            k = int(np.searchsorted(starts, begin, "right")) - 1
            text, first, _ = held[k]
            out[text].append((int(begin - starts[k]) + first, end - begin, period))
        held.clear()

    words = 0
    for i, ids in enumerate(texts):
        for begin, end in stretches(ids, shortest, least):
            if held and words + end - begin > block:
                work()
                words = 0
            held.append((i, begin, end))
            words += end - begin
    if held:
        work()
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words without those that a run has after its first period, joined by one space."""
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return " ".join([w for w, k in zip(words, kept, strict=True) if k]) if runs else " ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and the collapsed text for each row."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_WORD.findall(x) if x else [] for x in batch.column(1).to_pylist()]
            ids = []
            for each in words:
                number: dict[str, int] = {}
                ids.append([number.setdefault(w, len(number)) for w in each])
            runs = runs_of_texts(ids, shortest, least)
            told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for rows in runs]
            short = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            columns = [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(told, pa.list_(run)), pa.array(short, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return shipped(docs).select(F.col(key), F.col(text).cast("string")).mapInArrow(found, schema)


def made_periodic(key: Column, text: Column) -> Column:
    """The text, for every tenth checksum of the key with its words made periodic from a place on that the checksum gives."""
    mark = F.crc32(key.cast("string").cast("binary"))

    def edited(words: Column, g: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # As an element the array of words is made once, not anew for each of its places.
    words = F.array(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)))
    return F.when((mark % 10 == 0) & text.rlike(SPACED), F.get(F.transform(words, lambda w: edited(w, F.floor(mark / 10))), F.lit(0))).otherwise(text)


def digested(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op12: the run with the greatest length for its period, and digests of all runs and of the collapsed text."""
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    ahead = lambda x, y: (more(x, y) > 0) | ((more(x, y) == 0) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
