"""Token counts of a byte-level BPE vocabulary by merging with a heap over a linked list.

A text is cut at the vocabulary's special strings (a token each), the rest into pre-tokens. The bytes of a pre-token
are symbols in a linked list; adjacent pairs that merge lie in a heap by rank, then place. The lowest is popped and
merged as long as it still stands, which adds the pairs on both sides; the count is the initial symbols less the
merges, and no identifiers are looked up. Pre-tokens repeat, so each task remembers the counts of CACHE of them.

What counts as a letter, a number or a space is asked of the library's own pre-tokenizer, once on the driver, so that
versions of Unicode can't differ. A null text counts as empty: no bytes, no tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import shipped

LIMIT = 512
CACHE = 400_000
#: Pre-tokens longer than this aren't remembered.
CACHED_BYTES = 64
#: The pre-token pattern of byte-level vocabularies, with classes of letters L, numbers N and spaces S.
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Planes of Unicode that have characters; what lies between them and in private planes is of no class.
PLANES = (range(0, 0xD800), range(0xE000, 0x40000), range(0xE0000, 0xF0000))
_STEP = 1 << 15


@lru_cache(maxsize=1)
def library_classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of code points of L, N and S, as the library's byte-level pre-tokenizer cuts text: next to a letter only a letter isn't cut
    off, before a sign whatever is none of the three isn't."""
    from tokenizers import pre_tokenizers

    cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def cuts(points: list[int], before: str) -> tuple[list[bool], list[bool]]:
        left, right = [], []
        for k in range(0, len(points), _STEP):
            part = points[k : k + _STEP]
            ends = {end for _, (_, end) in cutter.pre_tokenize_str("".join(f"{before}{chr(c)}!" for c in part))}
            left += [3 * i + 1 in ends for i in range(len(part))]
            right += [3 * i + 2 in ends for i in range(len(part))]
        return left, right

    points = [c for plane in PLANES for c in plane]
    left, right = cuts(points, "a")
    found: dict[str, list[int]] = {"L": [c for c, cut in zip(points, left, strict=True) if not cut], "N": [], "S": []}
    others = sorted({0x20, *(c for c, a, b in zip(points, left, right, strict=True) if a and b)})
    for c, cut in zip(others, cuts(others, "1")[0], strict=True):
        found["S" if cut else "N"].append(c)
    out: dict[str, list[tuple[int, int]]] = {}
    for name, values in found.items():
        runs: list[tuple[int, int]] = []
        for c in values:
            if runs and runs[-1][1] == c - 1:
                runs[-1] = (runs[-1][0], c)
            else:
                runs.append((c, c))
        out[name] = runs
    return out


def byte_letters() -> dict[str, int]:
    """Letter by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Counting:
    """Counts tokens of texts; vocabulary is the content of a tokenizer's JSON file, with classes as `library_classes` gives them."""

    def __init__(self, vocabulary: dict) -> None:
        letters = byte_letters()
        ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank: dict[int, int] = {}  # by the pair's two symbols in one number
        self.both: list[int] = []  # the symbol that the pair of each rank becomes
        for rank, pair in enumerate(vocabulary["model"]["merges"]):
            one, other = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.both.append(ids.setdefault(one + other, len(ids)))
            self.rank.setdefault(ids[one] << 32 | ids[other], rank)
        special = sorted((t["content"] for t in vocabulary.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.patterns = [re.compile(PRE_TOKENS.format(**self._classes(vocabulary["classes"], last))) for last in (0x7F, 0xFFFF, 0x10FFFF)]
        self.known: dict[str, int] = {}

    @staticmethod
    def _classes(ranges: dict, last: int) -> dict[str, str]:
        """The classes, for texts without code points above last: fewer ranges are faster."""
        shown = lambda c: re.escape(chr(c))
        within = {k: [(a, min(b, last)) for a, b in runs if a <= last] for k, runs in ranges.items()}
        return {k: "".join(f"{shown(a)}-{shown(b)}" if a < b else shown(a) for a, b in runs) for k, runs in within.items()}

    def pieces(self, text: str) -> list[str]:
        wide = 0 if text.isascii() else 1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2
        return self.patterns[wide].findall(text)

    def pre_token(self, data: bytes) -> int:
        """Symbols, links and the heap's entries (rank and place in one number) are numbers in flat arrays, whatever the length."""
        n = len(data)
        rank, both = self.rank, self.both
        heap = [rank[pair] * n + i for i, pair in enumerate(a << 32 | b for a, b in zip(data, data[1:], strict=False)) if pair in rank]
        if not heap:
            return n
        heapq.heapify(heap)
        flat = list if n <= CACHED_BYTES else lambda x: array("i", iter(x))
        symbols, before, after = flat(data), flat(range(-1, n - 1)), flat(range(1, n + 1))
        after[n - 1] = -1
        left = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            one = symbols[i]
            if j < 0 or one < 0 or rank.get(one << 32 | symbols[j]) != r:  # one of the two has merged otherwise
                continue
            symbols[i] = new = both[r]
            symbols[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (x := rank.get(new << 32 | symbols[k])) is not None:
                    push(heap, x * n + i)
            if (h := before[i]) >= 0 and (x := rank.get(symbols[h] << 32 | new)) is not None:
                push(heap, x * n + h)
        return left

    def plain(self, text: str) -> int:
        total, known = 0, self.known
        for piece, times in Counter(self.pieces(text)).items():
            count = known.get(piece)
            if count is None:
                data = piece.encode()
                count = self.pre_token(data)
                if len(data) <= CACHED_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = count
            total += times * count
        return total

    def text(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def _counting(vocabulary: str) -> Counting:
    return Counting(json.loads(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens for each row. vocabulary: path of a tokenizer's JSON file on the driver, read there once;
    its content, a few MB, goes out with the function."""
    with open(vocabulary, encoding="utf-8") as file:
        whole = json.load(file)
    content = docs.sparkSession.sparkContext.broadcast(
        json.dumps({"model": {"merges": whole["model"]["merges"]}, "added_tokens": whole.get("added_tokens", []), "classes": library_classes()})
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(content.value)
        for batch in batches:
            n = [counting.text(x.as_py()) if x.is_valid else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    value = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = shipped(docs).select(F.col(key), size, value.alias("text"))
    return rows.mapInArrow(counted, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")


def limited(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
