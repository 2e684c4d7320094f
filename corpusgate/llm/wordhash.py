"""Hashes of the words of many texts at once, with numpy, for functions that Spark maps over Arrow batches.

Texts go through in blocks of about BLOCK bytes, so that memory doesn't depend on the size of a batch; a longer text
is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows as UTF-8, nulls as empty, with the first row's number."""
    first, run, held = 0, [], 0
    for i, value in enumerate(texts):
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        if run and held + len(data) > size:
            yield first, run
            first, run, held = i, [], 0
        run.append(data)
        held += len(data)
    if run:
        yield first, run


def hashed_words(texts: list[bytes], spaced: bool = True, places: bool = False) -> tuple:
    """The hashes of all words in order, and where each text's words start, plus the end.

    A-Z are lower-cased. spaced: words lie between ASCII white space; else they are runs of ASCII digits and letters
    and of what is above ASCII. places: also all bytes, and where in them each word starts and ends."""
    whole = b" ".join(texts).lower() + b" "
    data = np.frombuffer(whole, np.uint8)
    gap = (_SPACES if spaced else _PUNCTUATION)[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    offsets = np.searchsorted(starts, text_starts)
    if not len(starts):
        return (np.zeros(0, np.uint64), offsets, (whole, starts, ends)) if places else (np.zeros(0, np.uint64), offsets)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values = (data[~gap].astype(np.uint64) + np.uint64(1)) * odd_numbers(int(lengths.max()), 1)[place]
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return (mixed(sums), offsets, (whole, starts, ends)) if places else (mixed(sums), offsets)
