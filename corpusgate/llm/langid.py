"""Language identification of mixed-language text.

Training counts letter trigrams of words, with their ends, by language over a sample of labelled documents, and the
scripts that each language is written in. A word's candidates are the languages of its script; each scores the sum of
its trigrams' log probabilities. Viterbi over the words of a text, with a penalty for each switch of language, labels
every word; runs of one label are the spans. The language of a text is the one with most letters, and the score is
the share of its letters. Ties go to the language that comes first by name.

A text that is null or has no letter is ``und`` with score 0. A text whose letters are all of scripts that training
has not seen gets the commonest language, with score 0. Words between ASCII white space that have no letter take no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import shipped

#: Trigrams are counted in so many buckets.
BITS = 18
BUCKETS = 1 << BITS
#: Labelled documents that training takes: all up to about this many, else as many by a hash of doc_id.
SAMPLE = 20_000
#: Languages that are learned: those with most labelled documents of the sample. Bounds the model, which every worker holds.
LANGUAGES = 128
#: What a switch costs in Viterbi, in units of log probability.
SWITCH = 8.0
#: A language is a candidate for a script that at least this share of its training letters has.
SHARE = 0.001
BLOCK = 1 << 20
UND = "und"
_GAP = re.compile(r"\s")
#: First code points of the ranges of scripts, each up to the next; "" is no script of its own.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, ""), (0x0B80, "Tamil"), (0x0C00, ""), (0x0E00, "Thai"),
    (0x0E80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xA720, "Latin"),
    (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x30000, ""),
)
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_SCRIPT_AT = np.array([_NAMES.index(name) for _, name in SCRIPTS], np.int8)


class Model(NamedTuple):
    """languages by name; log probabilities by bucket and language; candidates by script and language; the commonest."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    commonest: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


class Words(NamedTuple):
    """Trigram buckets, where each word's begin, each word's number of letters and script, where each text's words begin."""

    buckets: np.ndarray
    starts: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[str]) -> Words:
    """The runs of letters of each text, lower-cased; a run ends where the script changes."""
    whole = " " + " ".join(texts).lower() + " "
    if len(whole) != sum(map(len, texts)) + len(texts) + 1 + (not texts):  # lower() may lengthen a text
        texts = [x.lower() for x in texts]
        whole = " " + " ".join(texts) + " "
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    script = _SCRIPT_AT[np.searchsorted(_STARTS, codes, "right") - 1] if codes.max() >= 0x370 else np.full(len(codes), _NAMES.index("Latin"), np.int8)
    other = letter[1:] != letter[:-1]
    turn = letter[1:] & letter[:-1] & (script[1:] != script[:-1])
    begins = np.flatnonzero((other & letter[1:]) | turn) + 1
    ends = np.flatnonzero((other & letter[:-1]) | turn) + 1
    # Trigrams around each letter: what is no letter of the same word counts as the word's edge.
    at = np.flatnonzero(letter)
    lengths = ends - begins
    inside = codes[at]
    first = np.zeros(len(at), bool)
    last = np.zeros(len(at), bool)
    starts = np.cumsum(lengths) - lengths
    if len(at):
        first[starts] = True
        last[np.cumsum(lengths) - 1] = True
    before = np.where(first, np.uint32(0), np.concatenate([inside[:1], inside[:-1]]))
    after = np.where(last, np.uint32(1), np.concatenate([inside[1:], inside[-1:]]))
    with np.errstate(over="ignore"):
        mix = (before * np.uint32(0x9E3779B1)) ^ (inside * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ (after * np.uint32(0xC2B2AE3D))
        mix = (mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        buckets = (mix >> np.uint32(32 - BITS)).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
    return Words(buckets, starts, lengths, script[begins], np.searchsorted(begins, text_starts))


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words by languages: the log probability of each candidate; -inf for the others, which aren't asked."""
    out = np.full((len(words.starts), len(model.languages)), -np.inf, np.float32)
    ends = np.append(words.starts[1:], len(words.buckets))
    scripts = np.unique(words.scripts)
    for script in scripts:
        at = np.flatnonzero(words.scripts == script)
        candidates = np.flatnonzero(model.candidates[script])
        if not len(candidates):
            out[at] = 0
            continue
        buckets, starts = words.buckets, words.starts
        if len(scripts) > 1:
            sizes = ends[at] - starts[at]
            first = np.cumsum(sizes) - sizes
            buckets = buckets[np.repeat(starts[at] - first, sizes) + np.arange(sizes.sum())]
            starts = first
        for i in candidates:
            out[at, i] = np.add.reduceat(model.scores[i][buckets], starts)
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word: for each text, the path of greatest score less `switch` for each change of label.

    All texts take a step together; the longest come first, so those still going are the first rows."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    if not n:
        return labels
    going = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with a word t, for each t
    best = np.empty(n, np.int16)  # the best label before each word
    stays = np.zeros((n, k), bool)  # whether each label goes on from itself
    value = scores[starts[: going[0]]].astype(np.float64)
    final = np.empty((len(sizes), k))
    for t in range(1, int(sizes[0])):
        m = going[t]
        if m < len(value):
            final[m : len(value)] = value[m:]
            value = value[:m]
        at = starts[:m] + t
        top = value.argmax(axis=1)
        jump = value[np.arange(m), top] - switch
        stay = value >= jump[:, None]
        best[at], stays[at] = top, stay
        value = np.where(stay, value, jump[:, None]) + scores[at]
    final[: len(value)] = value
    label = final[: going[0]].argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = going[t]
        at = starts[:m] + t
        now = label[:m]
        labels[at] = now
        if t:
            label[:m] = np.where(stays[at, now], now, best[at])
    return labels


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on docs (text, lang, doc_id) with a language; takes about `sample` of them at most, by a hash of doc_id and text.

    LANGUAGES languages at most are learned. What comes to the driver is a count for each of them and each trigram bucket: BUCKETS
    for a language at most."""
    rows = shipped(docs).filter("text is not null and lang is not null")
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    learned = rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rows = rows.filter(F.col("lang").cast("string").isin([r.lang for r in learned.collect()]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in batches:
            text, lang = batch.column(0), batch.column(1)
            for i in range(len(text)):
                name = lang[i].as_py()
                words = words_of([text[i].as_py()])
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                np.add.at(sums[name], words.buckets, 1)
                scripts[name] = scripts.get(name, 0) + np.bincount(words.scripts, words.letters, len(_NAMES)).astype(np.int64)
                texts_of[name] = texts_of.get(name, 0) + 1
        for name, array in sums.items():
            for kind, values in (("bucket", array), ("script", scripts[name]), ("texts", np.array([texts_of[name]]))):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(values[at].astype(np.int64))],
                    ["lang", "kind", "at", "n"],
                )

    parts = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(counted, "lang string, kind string, at bigint, n bigint")
    found = parts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in found}) or [UND]
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS), np.float32)
    scripts = np.zeros((len(languages), len(_NAMES)))
    texts = np.zeros(len(languages))
    for r in found:
        {"bucket": counts, "script": scripts, "texts": texts[:, None]}[r.kind][place[r.lang], r.at] = r.n
    seen = max(1, int((counts.max(axis=0) > 0).sum()))
    whole = counts.sum(axis=1, keepdims=True, dtype=np.float64)
    counts += np.float32(0.1)
    scores = np.log(counts, out=counts)
    scores -= np.log(whole + 0.1 * seen).astype(np.float32)
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(languages, scores, np.ascontiguousarray((share >= SHARE).T), int(texts.argmax()))


def _pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """A long text in pieces of about `size`, cut at white space."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def labelled(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters, script and label of each word, and where each text's words begin.

    A text that is a block of its own is read and scored piece by piece; only what is kept for each word grows with it."""
    parts = [words_of(texts)] if len(texts) > 1 else map(words_of, ([x] for x in _pieces(texts[0])))
    letters, scripts, scores, offsets = [], [], [], np.zeros(1, np.int64)
    for words in parts:
        letters.append(words.letters)
        scripts.append(words.scripts)
        scores.append(word_scores(model, words))
        offsets = words.offsets if len(texts) > 1 else np.array([0, offsets[-1] + words.offsets[-1]])
    letters, scripts, scores = np.concatenate(letters), np.concatenate(scripts), np.concatenate(scores)
    return letters, scripts, viterbi(scores, offsets) if len(scores) else np.zeros(0, np.int16), offsets


def _letters_by_language(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: letters by language, and all letters."""
    letters, scripts, labels, offsets = labelled(model, texts)
    k = len(model.languages)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    known = model.candidates[scripts].any(axis=1) if len(scripts) else np.zeros(0, bool)
    all_letters = np.bincount(text, letters, len(texts))
    return np.bincount(text * k + labels, letters * known, len(texts) * k).reshape(-1, k), all_letters


def _blocks(values: pa.Array, size: int = BLOCK) -> Iterator[list[str]]:
    run, held = [], 0
    for x in values:
        text = x.as_py() or ""
        if run and held + len(text) > size:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with lang_pred and score, from their text alone; columns of docs by these names are replaced."""
    rows = shipped(docs).drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for texts in _blocks(batch.column(at).cast(pa.string())):
                by, letters = _letters_by_language(sent.value, texts)
                top = np.where(by.max(axis=1) > 0, by.argmax(axis=1), sent.value.commonest)
                names += [sent.value.languages[i] if n else UND for i, n in zip(top, letters, strict=True)]
                scores += list(by[np.arange(len(top)), top] / np.maximum(1, letters))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    schema = rows.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    for field in schema.fields:
        field.nullable = True
    return rows.mapInArrow(identified, schema)


def spans(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, first_word, n_words, n_letters, lang: the runs of one language in each text, in words of letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            done = 0
            for texts in _blocks(batch.column(1).cast(pa.string())):
                of_word, _, labels, offsets = labelled(sent.value, texts)
                text = np.repeat(np.arange(len(texts)), np.diff(offsets))
                new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])])[: len(labels)])
                sizes = np.diff(np.concatenate([new, [len(labels)]]))
                letters = np.add.reduceat(of_word, new) if len(new) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(text[new] + done)),
                        pa.array((new - offsets[text[new]]).astype(np.int64)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(letters.astype(np.int64)),
                        pa.array([sent.value.languages[i] for i in labels[new]], pa.string()),
                    ],
                    [key, "first_word", "n_words", "n_letters", "lang"],
                )
                done += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    return shipped(docs).select(key, "text").mapInArrow(spanned, f"`{key}` {kind}, first_word bigint, n_words bigint, n_letters bigint, lang string")


def held_out():
    """Whether a document is kept from training: a third, by the checksum of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learns from the labelled documents that aren't held out."""
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("text")
