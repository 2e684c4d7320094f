"""License scans: phrases, and license texts found by a positional index of rare words.

Words are runs of ASCII digits, ASCII letters (lower-cased) and everything above ASCII.

- Phrases (PHRASES) are found wherever their words stand one after another.
- License texts (licensetexts.TEXTS) are found by their rare words. How many documents hold each of their words is counted
  over all documents. A text's anchors are its rarest words, enough of them that the others weigh less than half of SCORE.
  A document looks up its anchors in the postings (word, text, position). Where a text would begin is a place's position in
  the document less that in the text; words that were put in or left out move it, so places vote for two neighbouring
  ranges of beginnings, as wide as the text's band (`band`). Where votes have enough weight for the other words to fill it up
  to SCORE, all words are compared: from a beginning on, words of the text count that stand in their place, and those that
  stand beside their neighbour, moved by less than a band. A beginning with SCORE of the text's weight, in a document with
  all its key phrases, is a match: so up to a quarter of a text's length may be put in, as by signs of comments, or left out.

Each row is matched by itself, in blocks of BLOCK words that overlap by the longest text, so rows that repeat a doc_id, or
have none, get what their text alone gives, and memory doesn't depend on a text's length. A document without any text's first
key phrase isn't looked up. Null text counts as empty. The texts are part of this package, so vocabulary, postings and what is
counted for them have a fixed size.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.arrays import let, literal, running
from corpusgate.llm.common import PLAIN, ascii_lower, materialised, text_or_empty
from corpusgate.llm.licensetexts import TEXTS

#: Phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a text's weight that an alignment must have.
SCORE = 0.7
#: Weights are whole parts of this, so that sums are exact.
UNIT = 1_000_000
#: Words of a document that are looked up at a time.
BLOCK = 4096
_WORD = re.compile(r"[0-9a-z]+")
WORDS = [_WORD.findall(text.lower()) for _, _, text in TEXTS]
LONGEST = max(map(len, WORDS))
VOCABULARY = sorted({w for words in WORDS for w in words})
_KEYS = [[f" {k} " for k in keys] for _, keys, _ in TEXTS]


def band(words: list[str]) -> int:
    """Beginnings that one match of a text may have: a quarter of its words, four at least."""
    return max(4, len(words) // 4)


BANDS = [band(words) for words in WORDS]


class Index(NamedTuple):
    """postings: by anchor, its text, position, weight and the text's band; weights: by text, of each position; need: what anchors must agree on."""

    postings: dict[str, list[dict[str, int]]]
    weights: list[list[int]]
    need: list[int]


def rarities(known: DataFrame) -> dict[str, float]:
    """log((documents + 1) / documents that hold it) of each word of VOCABULARY, from a column known of each document's
    distinct ones; a row for each of them comes to the driver."""
    rows = known.select(F.explode(F.concat(F.array(F.lit("")), "known")).alias("word"))
    held = {r.word: r.df for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    return {w: math.log((held.get("", 0) + 1) / max(1, held.get(w, 0))) for w in VOCABULARY}


def index(idf: dict[str, float]) -> Index:
    out = Index({}, [], [])
    for n, words in enumerate(WORDS):
        whole = sum(idf[w] for w in words) or 1.0
        weights = [round(UNIT * idf[w] / whole) for w in words]
        others = sum(weights)
        for anchor in sorted(set(words), key=lambda w: (-idf[w], w)):
            if 2 * others < SCORE * UNIT:
                break
            places = [i for i, w in enumerate(words) if w == anchor]
            out.postings.setdefault(anchor, []).extend({"n": n, "p": i, "w": weights[i], "b": BANDS[n]} for i in places)
            others -= sum(weights[i] for i in places)
        out.weights.append(weights)
        out.need.append(max(1, math.ceil(SCORE * UNIT) - others))
    return out


_TEXT = "array<struct<words:array<string>,pairs:map<string,array<int>>,weights:array<bigint>,band:int>>"


def _texts(found: Index) -> list[dict]:
    """Of each text: its words, where its pairs of neighbouring words stand, the weight of each word, its band."""
    out = []
    for words, weights, width in zip(WORDS, found.weights, BANDS, strict=True):
        pairs: dict[str, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            pairs.setdefault(" ".join(pair), []).append(i)
        out.append({"words": words, "pairs": pairs, "weights": weights, "band": width})
    return out


def _constant(value: object, kind: str) -> str:
    """A literal of a nested type: Spark folds it once."""
    return f"from_json({literal(json.dumps(value))}, '{kind}')"


def alignments(words: str, found: Index) -> str:
    """SQL for the matches in an array of words: array<struct<notice, share>>, share in parts of UNIT."""
    none = "CAST(array() AS array<struct<notice:int,share:bigint>>)"
    if not found.postings:  # no documents, no weights
        return none
    postings = _constant(found.postings, "map<string,array<struct<n:int,p:int,w:bigint,b:int>>>")
    asked = ", ".join(map(literal, sorted(found.postings)))
    reach = BLOCK + LONGEST + 2 * max(BANDS)
    places = f"filter(sequence(s, least(size({words}), s + {reach}) - 1), i -> {words}[i] IN ({asked}))"
    vote = "named_struct('n', p.n, 'begin', (CAST(floor((i - p.p) / p.b) AS INT) - back) * p.b, 'w', p.w)"
    inside = f"v -> (s = 0 OR v.begin >= s) AND v.begin < s + {BLOCK}"
    of_place = f"flatten(transform(array(0, 1), back -> transform(element_at({postings}, {words}[i]), p -> {vote})))"
    votes = f"array_sort(flatten(transform({places}, i -> filter({of_place}, {inside}))))"
    agreed = running(votes, "named_struct('n', y.n, 'begin', y.begin, 'w', y.w + CASE WHEN x.n = y.n AND x.begin = y.begin THEN x.w ELSE 0L END)", "named_struct('n', -1, 'begin', 0, 'w', 0L)")
    enough = f"filter({agreed}, c -> c.w >= element_at({_constant(found.need, 'array<bigint>')}, c.n + 1))"
    begins = f"array_distinct(transform({enough}, c -> named_struct('n', c.n, 'begin', c.begin)))"
    standing = f"filter(coalesce(try_element_at(t.pairs, concat(get({words}, i), ' ', get({words}, i + 1))), CAST(array() AS array<int>)), p -> i - p >= c.begin AND i - p < c.begin + 2 * t.band)"
    near = "sequence(greatest(c.begin, 0), greatest(c.begin + 2 * t.band + size(t.words), 0))"
    pairs = f"flatten(transform({near}, i -> transform({standing}, p -> named_struct('begin', i - p, 'p', p))))"
    moved = "flatten(transform(filter(pairs, x -> x.begin >= b AND x.begin < b + t.band), x -> array(x.p, x.p + 1)))"
    placed = f"filter(sequence(0, size(t.words) - 1), p -> b + p >= 0 AND coalesce(get({words}, b + p) = t.words[p], false))"
    covered = f"array_distinct(concat({moved}, {placed}))"
    share = f"array_max(transform(array_distinct(transform(pairs, x -> x.begin)), b -> aggregate({covered}, 0L, (a, p) -> a + t.weights[p])))"
    text = f"element_at({_constant(_texts(found), _TEXT)}, c.n + 1)"
    aligned = f"transform({begins}, c -> named_struct('notice', c.n, 'share', {let('t', text, let('pairs', pairs, f'coalesce({share}, 0L)'))}))"
    whole = f"filter(flatten(transform(sequence(0, greatest(size({words}) - 1, 0), {BLOCK}), s -> {aligned})), m -> m.share >= {math.ceil(SCORE * UNIT)})"
    keys = f"forall(element_at({_constant(_KEYS, 'array<array<string>>')}, m.notice + 1), k -> contains(joined, k))"
    sure = let("joined", f"concat(' ', array_join({words}, ' '), ' ')", f"filter({let('found', whole, 'found')}, m -> {keys})")
    return f"CASE WHEN size({words}) > 0 THEN {sure} ELSE {none} END"


def _starts(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase stands."""
    parts = phrase.split(" ")
    first = F.sequence(F.lit(1), F.greatest(F.size(words) - len(parts) + 1, F.lit(1)))

    def here(i: Column) -> Column:
        ok = F.try_element_at(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.try_element_at(words, i + k) == part, F.lit(False))
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter(first, here), lambda i: (i - 1).cast("bigint"))


def _places(words: Column) -> Column:
    def labelled(label: str):
        return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))

    return F.array_sort(F.concat(*[F.transform(_starts(words, phrase), labelled(label)) for phrase, label in PHRASES.items()]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (array<struct<start, label>> of phrases in order), labels (of phrases and texts,
    sorted), score: 1 where a phrase stands, else the best alignment's share, 0 without any.

    One pass over the texts, which writes what little the index needs; the second one reads that."""
    words = F.regexp_extract_all(ascii_lower(text_or_empty()), F.lit(PLAIN), F.lit(0))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    asked = F.lit(False)
    for key in sorted({keys[0] for keys in _KEYS}):
        asked = asked | F.contains("joined", F.lit(key))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    read = docs.select("doc_id", words.alias("words")).select("doc_id", "words", joined.alias("joined"))
    read = read.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.array_intersect("words", F.array(*[F.lit(w) for w in VOCABULARY])).alias("known"),
        F.when(F.contains("joined", F.lit(" license ")), _places(F.col("words"))).otherwise(none).alias("places"),
        F.when(asked, F.col("words")).otherwise(F.array().cast("array<string>")).alias("held"),
    )
    read = materialised(read, "license-words")
    found = index(rarities(read.select("known")))
    rows = read.select("doc_id", "n_words", "places", F.expr(alignments("held", found)).alias("matches"))
    names = F.array(*[F.lit(label) for label, _, _ in TEXTS])
    labels = F.concat(F.transform("places", lambda x: x["label"]), F.transform("matches", lambda m: F.get(names, m["notice"])))
    best = F.array_max(F.transform("matches", lambda m: m["share"]))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0)) / F.lit(float(UNIT))))
    return rows.select("doc_id", "n_words", "places", F.array_sort(F.array_distinct(labels)).alias("labels"), score.alias("score"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    starts = F.transform("places", lambda x: x["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
