"""Alignment of two tokenizers over a corpus: groups of tokens that span the same bytes, linked through a dictionary of distinct groups.

Every text gets a space in front and is cut before each space that follows a sign other than white space. Neither tokenizer has a token over
such a cut, so each distinct piece of a block of documents is encoded once. Where tokens of both end at the same byte, a group ends. Distinct
groups are interned by a 128-bit digest of their ids; a block of documents holds places in its own list of groups. Links (a token of each that
overlap) are counted for each pair of ids by documents within a block and summed over blocks; they are expanded once for each distinct group of
the corpus, multiplied by how often the group has them, and the group's sums go back to the blocks by its digest.

A block holds about BLOCK_BYTES of text, or one longer text. Nothing is keyed by document: repeated and null doc_ids are rows like others. A
text that is null or empty, or that one of the tokenizers doesn't give back byte for byte, has no tokens: zeros and no groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import materialised, shipped
from corpusgate.llm.tokencount import byte_letters

BLOCK_BYTES = 8 << 20
#: What lies between places where no token of either tokenizer goes on: spaces after a sign that isn't white space.
_PIECE = re.compile(r" [^ ]*(?:(?<!\S) [^ ]*)*")
_SPACE = "▁"
#: Pieces that a worker remembers with their tokens, up to the block in which they become more.
KNOWN = 500_000
_ENCODED = 4096


class Flat(NamedTuple):
    """Arrays of different lengths in one: array i is values[starts[i]:starts[i + 1]]."""

    values: np.ndarray
    starts: np.ndarray


def flat(lists: list[list[int]]) -> Flat:
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return Flat(np.fromiter(chain.from_iterable(lists), np.int32, starts[-1]), starts)


def joined(parts: list[Flat]) -> Flat:
    """The arrays of all parts, in order."""
    before = np.cumsum([0, *(len(p.values) for p in parts)])
    starts = [np.zeros(1, np.int64), *(p.starts[1:] + n for p, n in zip(parts, before, strict=False))]
    return Flat(np.concatenate([p.values for p in parts]), np.concatenate(starts))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])]


def gathered(rows: Flat, at: np.ndarray) -> Flat:
    """The arrays at the given places, in that order."""
    sizes = (rows.starts[1:] - rows.starts[:-1])[at]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(rows.starts[at] - starts[:-1], sizes) + np.arange(starts[-1])
    return Flat(rows.values[places], starts)


class Tokenizers:
    """Both libraries, the bytes of their tokens, and the lengths of these."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
        if any(_SPACE in n.lstrip(_SPACE) for n in names):
            raise ValueError("a piece goes on over a space, so texts can't be cut there")
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.lone_space = self.b.encode("x ")[len(self.b.encode("x")) :]

        self.known: dict[str, int] = {}
        self.a_known = self.b_known = flat([])

    def interned(self, texts: list[str]) -> tuple[Flat, Flat, Flat]:
        """Places of each text's pieces among the pieces that this worker knows, and these pieces' ids of A and of B."""
        if len(self.known) > KNOWN:
            self.known.clear()
            self.a_known = self.b_known = flat([])
        known, before = self.known, len(self.known)
        places = flat([[known.setdefault(p, len(known)) for p in _PIECE.findall(f" {text}")] if text else [] for text in texts])
        new = list(islice(known, before, None))
        parts = [self.encode(new[k : k + _ENCODED]) for k in range(0, len(new), _ENCODED)]
        self.a_known, self.b_known = joined([self.a_known, *(a for a, _ in parts)]), joined([self.b_known, *(b for _, b in parts)])
        return places, self.a_known, self.b_known

    def encode(self, pieces: list[str]) -> tuple[Flat, Flat]:
        """Ids of pieces that begin with a space; the second tokenizer adds that space itself. Pieces that don't come back have none."""
        a, b = self._encode_a(pieces), flat(self.b.encode([p[1:] for p in pieces], num_threads=1))
        if any(p == " " for p in pieces):
            b = flat([self.lone_space if p == " " else b.values[i:j].tolist() for p, i, j in zip(pieces, b.starts[:-1], b.starts[1:], strict=True)])
        data = "".join(pieces).encode()
        if _SPACE in "".join(pieces) or not self._gives(a, self.a_bytes, data) or not self._gives(b, self.b_bytes, data):
            same = [
                _SPACE not in p and self._gives(gathered(a, np.array([i])), self.a_bytes, p.encode()) and self._gives(gathered(b, np.array([i])), self.b_bytes, p.encode())
                for i, p in enumerate(pieces)
            ]
            a, b = (flat([x.values[i:j].tolist() if ok else [] for ok, i, j in zip(same, x.starts[:-1], x.starts[1:], strict=True)]) for x in (a, b))
        return a, b

    @staticmethod
    def _gives(ids: Flat, names: list[bytes], data: bytes) -> bool:
        return b"".join(map(names.__getitem__, ids.values.tolist())) == data

    def _encode_a(self, pieces: list[str]) -> Flat:
        """Pieces that end in a sign are encoded in one text, and its ids dealt to them by their bytes; the others one by one."""
        plain = [not p[-1:].isspace() for p in pieces]
        row = [p for p, ok in zip(pieces, plain, strict=True) if ok]
        ids = np.array(self.a.encode_batch_fast(["".join(row)], add_special_tokens=False)[0].ids if row else [], np.int32)
        starts = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum([0, *(len(p.encode()) for p in row)]), "right")
        starts[:1] = 0
        if all(plain):
            return Flat(ids, starts)
        shared = iter(zip(starts[:-1], starts[1:], strict=True))
        alone = iter(self.a.encode_batch_fast([p for p, ok in zip(pieces, plain, strict=True) if not ok], add_special_tokens=False))
        return flat([ids[slice(*next(shared))].tolist() if ok else next(alone).ids for ok in plain])


@lru_cache(maxsize=1)
def _tokenizers(byte_level: str, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


class Groups(NamedTuple):
    """Of a row of tokens of both: where groups begin among A's and B's tokens (and the ends), and of each link, in order of bytes, its group and tokens."""

    a_starts: np.ndarray
    b_starts: np.ndarray
    link_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def grouped(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Groups:
    """Groups and links of tokens by their sizes in bytes; both rows have the same total.

    Bytes between two neighbouring ends, whichever tokenizer's, are what one token of each shares: each such stretch is a link."""
    ends_a, ends_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
    stretches = np.union1d(ends_a, ends_b)
    zero = np.zeros(1, np.int64)
    return Groups(
        np.concatenate([zero, np.searchsorted(ends_a, ends, "right")]),
        np.concatenate([zero, np.searchsorted(ends_b, ends, "right")]),
        np.searchsorted(ends, stretches),
        np.searchsorted(ends_a, stretches),
        np.searchsorted(ends_b, stretches),
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(a: Flat, b: Flat) -> np.ndarray:
    """Two 64-bit numbers for each group: sums over its tokens of mixed (id, place in the group, tokenizer)."""
    out = np.zeros((2, len(a.starts) - 1), np.uint64)
    for side, rows in enumerate((a, b)):
        places = np.arange(len(rows.values)) - np.repeat(rows.starts[:-1], np.diff(rows.starts))
        key = (places.astype(np.uint64) << np.uint64(33)) + (rows.values.astype(np.uint64) << np.uint64(1)) + np.uint64(side)
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            out[k] += np.add.reduceat(_mixed(_mixed(key + np.uint64(seed))), rows.starts[:-1]) if len(key) else np.uint64(0)
    return out.view(np.int64)


_ROW = pa.schema(
    [
        ("kind", pa.int8()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("places", pa.list_(pa.int32())),
        ("g", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
        ("id_a", pa.int32()), ("id_b", pa.int32()), ("n", pa.int64()),
    ]
)
_SPARK_ROW = (
    "kind tinyint, block bigint, n_a bigint, n_b bigint, n_links bigint, places array<int>, g int, h1 bigint, h2 bigint, a array<int>, b array<int>, "
    "id_a int, id_b int, n bigint"
)
_DOCUMENT, _GROUP, _PAIR = 0, 1, 2


def _rows(key: pa.Field, kind: int, block: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the named columns; the others are null."""
    n = len(next(iter(columns.values())))
    columns = {**columns, "kind": pa.array(np.full(n, kind), pa.int8()), "block": pa.array(np.full(n, block), pa.int64())}
    schema = pa.schema([key.with_nullable(True), *_ROW])
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _lists(rows: Flat) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.starts, pa.int32()), pa.array(rows.values, pa.int32()))


def block_rows(number: int, key: pa.Array, texts: list[str], both: Tokenizers, field: pa.Field) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its documents with places in its list of groups, the list, and for each linked pair of ids how many documents hold it."""
    pieces, known_a, known_b = both.interned(texts)
    lost = np.flatnonzero(np.diff(known_a.starts) == 0)
    if len(lost):
        owner = np.repeat(np.arange(len(texts)), np.diff(pieces.starts))
        bad = np.unique(owner[np.isin(pieces.values, lost)])
        kept = ~np.isin(owner, bad)
        pieces = Flat(pieces.values[kept], np.searchsorted(owner[kept], np.arange(len(texts) + 1)))
    used = distinct(pieces.values)
    pieces = Flat(np.searchsorted(used, pieces.values), pieces.starts)
    a, b = gathered(known_a, used), gathered(known_b, used)
    groups = grouped(both.a_sizes[a.values], both.b_sizes[b.values])
    of_groups = Flat(a.values, groups.a_starts), Flat(b.values, groups.b_starts)
    # Intern the groups of this block's pieces: `place` is each group's place in the list of distinct ones.
    h1, h2 = digests(*of_groups)
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    # Groups begin anew with each piece, as both tokenizers end a token there.
    piece_groups = Flat(place, np.searchsorted(groups.a_starts, a.starts))
    piece_links = np.diff(np.searchsorted(groups.link_group, piece_groups.starts))
    owner = np.repeat(np.arange(len(texts)), np.diff(pieces.starts))
    counted = lambda per_piece: pa.array(np.bincount(owner, per_piece[pieces.values], len(texts)).astype(np.int64))
    in_order = gathered(piece_groups, pieces.values)
    ends = in_order.starts[pieces.starts]
    own = {"n_a": counted(np.diff(a.starts)), "n_b": counted(np.diff(b.starts)), "n_links": counted(piece_links), "places": _lists(Flat(in_order.values, ends))}
    yield _rows(field, _DOCUMENT, number, {field.name: key, **own})
    if not len(first):
        return
    listed = gathered(of_groups[0], first), gathered(of_groups[1], first)
    numbers = {"g": pa.array(np.arange(len(first)), pa.int32()), "h1": pa.array(h1[first]), "h2": pa.array(h2[first])}
    yield _rows(field, _GROUP, number, {**numbers, "a": _lists(listed[0]), "b": _lists(listed[1])})
    # Documents by pair: a document's distinct groups, their distinct pairs, each pair of a document once.
    held = distinct(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends)) * len(first) + in_order.values)
    links = links_of(*listed, both.a_sizes, both.b_sizes)
    names, code = np.unique(links.values, return_inverse=True)
    of_held = gathered(Flat(code, links.starts), held % len(first))
    once = distinct(np.repeat(held // len(first), np.diff(of_held.starts)) * len(names) + of_held.values)
    n = pa.array(np.bincount(once % len(names), minlength=len(names)))
    yield _rows(field, _PAIR, number, {"id_a": pa.array(names >> 32, pa.int32()), "id_b": pa.array(names & 0xFFFFFFFF, pa.int32()), "n": n})


def aligned_blocks(docs: DataFrame, key: str, text: str, byte_level: str, pieces: str, block_bytes: int) -> DataFrame:
    """The rows of all blocks, a kind for each of the three; files are read on the driver, once."""
    with open(byte_level, encoding="utf-8") as one, open(pieces, "rb") as other:
        content = docs.sparkSession.sparkContext.broadcast((one.read(), other.read()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*content.value)
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        texts: list[str] = []
        held = 0
        field = None

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if texts:
                yield from block_rows(number, pa.concat_arrays(keys), texts, both, field)
            number += 1
            held = 0
            keys.clear()
            texts.clear()

        for batch in batches:
            field = batch.schema.field(0)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):
                before = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, before + block_bytes - held, "right")))
                keys.append(batch.column(0).slice(at, stop - at))
                texts += [x or "" for x in batch.column(1).slice(at, stop - at).to_pylist()]
                held += int(sizes[stop - 1]) - before
                at = stop
                if held >= block_bytes or at < len(batch):
                    yield from block()
        yield from block()

    kind = docs.schema[key].dataType.simpleString()
    return shipped(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(rows, f"key {kind}, {_SPARK_ROW}")


def links_of(a: Flat, b: Flat, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Flat:
    """The links of groups, as A's id in the high and B's in the low 32 bits."""
    groups = grouped(a_sizes[a.values], b_sizes[b.values])
    codes = a.values[groups.link_a].astype(np.int64) << 32 | b.values[groups.link_b]
    return Flat(codes, np.searchsorted(groups.link_group, np.arange(len(a.starts))))


def _expanded(groups: DataFrame, sizes) -> DataFrame:
    """h1, h2, id_a, id_b, times: the links of each distinct group."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (Flat(x.flatten().to_numpy(), np.asarray(x.offsets) - x.offsets[0].as_py()) for x in (batch.column("a"), batch.column("b")))
            found = links_of(a, b, *sizes.value)
            group = np.repeat(np.arange(len(batch)), np.diff(found.starts))
            order = np.lexsort((found.values, group))
            codes, group = found.values[order], group[order]
            new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (group[1:] != group[:-1])]))
            times = np.diff(np.append(new, len(codes)))
            h1, h2 = (batch.column(h).take(pa.array(group[new])) for h in ("h1", "h2"))
            codes = codes[new]
            columns = [h1, h2, pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id_a", "id_b", "times"])

    return groups.mapInArrow(links, "h1 bigint, h2 bigint, id_a int, id_b int, times bigint")


class Alignment(NamedTuple):
    """documents: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. pairs: id_a, id_b, documents, is_best."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Alignment:
    """Groups of the tokens of a byte-level vocabulary (A, a JSON file) and of a model of pieces (B), for each document.

    `groups` has A's ids, then B's, of each group: ``a1,a2|b1;a3|b2,b3``. A pair's documents are those that hold it linked; n_best counts the
    document's links whose pair has the most documents of A's id, ties included, and count_sum adds up the documents of all its links."""
    rows = materialised(aligned_blocks(docs, key, text, byte_level, pieces, block_bytes), "alignment")
    pairs = rows.filter(F.col("kind") == _PAIR).groupBy("id_a", "id_b").agg(F.sum("n").alias("documents"))
    # One row for each id of A's vocabulary at most.
    best = pairs.groupBy("id_a").agg(F.max("documents").alias("most"))
    pairs = pairs.join(F.broadcast(best), "id_a").select("id_a", "id_b", "documents", (F.col("documents") == F.col("most")).alias("is_best"))
    listed = rows.filter(F.col("kind") == _GROUP)
    with open(byte_level, encoding="utf-8") as one, open(pieces, "rb") as other:
        both = Tokenizers(one.read(), other.read())
    sizes = docs.sparkSession.sparkContext.broadcast((both.a_sizes, both.b_sizes))
    links = _expanded(listed.groupBy("h1", "h2").agg(F.min("a").alias("a"), F.min("b").alias("b")), sizes)
    sums = (
        links.join(pairs, ["id_a", "id_b"])
        .groupBy("h1", "h2")
        .agg(F.sum(F.col("times") * F.col("documents")).alias("counts"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best"))
    )
    label = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    lists = listed.select("block", "g", "h1", "h2", label.alias("label")).join(sums, ["h1", "h2"]).select("block", "g", "label", "counts", "best")
    kind = docs.schema[key].dataType.simpleString()
    own = rows.filter(F.col("kind") == _DOCUMENT).select("key", F.col("block").alias("own"), "n_a", "n_b", "n_links", "places")

    def told(block: pa.Table, groups: pa.Table) -> pa.Table:
        """A block's documents with what its groups add up to."""
        places = block.column("places").combine_chunks()
        places = places.combine_chunks() if isinstance(places, pa.ChunkedArray) else places
        at = Flat(places.flatten().to_numpy(), np.asarray(places.offsets) - places.offsets[0].as_py())
        order = np.argsort(groups.column("g").to_numpy())
        labels = np.array(groups.column("label").to_pylist(), object)[order]

        def added(name: str) -> pa.Array:
            each = groups.column(name).to_numpy()[order][at.values] if len(order) else np.zeros(0, np.int64)
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(each)])[at.starts]))

        texts = [";".join(labels[at.values[i:j]]) if j > i else "" for i, j in zip(at.starts[:-1], at.starts[1:], strict=True)]
        n_groups = pa.array(np.diff(at.starts).astype(np.int64))
        columns = [*(block.column(c) for c in ("key", "n_a", "n_b")), n_groups, block.column("n_links"), added("best"), added("counts"), pa.array(texts, pa.string())]
        return pa.table(columns, names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    schema = f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return Alignment(own.groupBy("own").cogroup(lists.groupBy("block")).applyInArrow(told, schema), pairs)


def digested(aligned: DataFrame) -> DataFrame:
    """The columns of op13: groups as a digest, empty without tokens."""
    told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return aligned.select(*[c for c in aligned.columns if c != "groups"], told)
