"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its lines. Each line is hashed to a wide vector, and a fingerprint is the sum of the
vectors of its lines, so it doesn't depend on their order, and lines are added or taken away without the rest of
the text. A vector has two parts:

- LANES words of 32 bits from SHA-256, summed modulo 2**32: equal sums mean equal multisets of lines.
- BITS counters, one for each of as many hash bits of each clause of the line (a run without one of ``.,;:!?``;
  one of more than LONG characters is cut further, after words that end in one of ENDING),
  and the number of clauses. Counters add up too; read as sums of +1 and -1 they are random projections of the
  multiset of clauses, so the cosine of two of them estimates how much of their clauses two texts share.

A null text is taken as empty; the empty text is one empty line without clauses. Repeated lines count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import text_or_empty

LANES = 16
BITS = 120
WORD = 1 << 32
#: Counters lie in pairs in one long, 30 bits apart.
PAIR = 30
_MASK = (1 << PAIR) | 1
_LOW = (1 << PAIR) - 1
#: Characters of a clause that isn't cut further, and last letters of words after which longer ones are: some four in ten words.
LONG = 64
ENDING = "adhlotyADHLOTYáéíóúаеиоуыяαεηιουω"
_ENDS = f"([{ENDING}][!-/:-@\\[-`{{-~]{{0,8}})[ \\t]+"


def _hex(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("bigint")


def _line_sums(lines: Column) -> Column:
    digests = F.transform(lines, lambda p: F.concat(F.sha2(p, 256), F.sha2(F.concat(F.lit("2|"), p), 256)))
    start = F.array(*[F.lit(0).cast("bigint")] * LANES)
    return F.aggregate(
        digests,
        start,
        lambda acc, d: F.zip_with(acc, F.array(*[_hex(d, 1 + 8 * i, 8) for i in range(LANES)]), lambda a, b: (a + b) % WORD),
    )


def _clause_sums(hashes: Column) -> Column:
    """Counter pairs: 30 for each half of the clauses' hashes."""
    shifts = F.array(*[F.lit(i) for i in range(PAIR)])

    def half(name: str) -> Column:
        return F.transform(
            shifts,
            lambda s: F.aggregate(
                hashes,
                F.lit(0).cast("bigint"),
                lambda acc, h: acc + F.call_function("shiftright", h[name], s).bitwiseAND(F.lit(_MASK)),
            ),
        )

    return F.concat(half("a"), half("b"))


def clauses(text: Column) -> Column:
    """The clauses of a text, trimmed, without empty ones. A long one ends after each word whose last letter is one of ENDING as well, so that a text
    without signs still has parts; where it is cut depends on the words there alone."""
    split = lambda c: F.split(F.regexp_replace(c, _ENDS, "$1\n"), "\n", -1)
    parts = F.transform(F.split(text, "[.,;:!?\\n]", -1), lambda c: F.when(F.char_length(c) > LONG, split(c)).otherwise(F.array(c)))
    return F.filter(F.transform(F.flatten(parts), lambda c: F.trim(c)), lambda c: c != "")


def fingerprint(text: Column) -> Column:
    """Text -> struct<lanes array<long>, n long, counts array<long>>; counts holds pairs of counters."""
    hashes = F.transform(clauses(text), F.md5)
    hashes = F.transform(hashes, lambda d: F.struct(_hex(d, 1, 15).alias("a"), _hex(d, 16, 15).alias("b")))
    return F.struct(
        _line_sums(F.split(text, "\\n", -1)).alias("lanes"),
        F.size(hashes).cast("bigint").alias("n"),
        _clause_sums(hashes).alias("counts"),
    )


def add(one: Column, other: Column) -> Column:
    """The fingerprint of all lines of both texts together."""
    return F.struct(
        F.zip_with(one["lanes"], other["lanes"], lambda a, b: (a + b) % WORD).alias("lanes"),
        (one["n"] + other["n"]).alias("n"),
        F.zip_with(one["counts"], other["counts"], lambda a, b: a + b).alias("counts"),
    )


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint of the lines of whole without those of part."""
    return F.struct(
        F.zip_with(whole["lanes"], part["lanes"], lambda a, b: F.pmod(a - b, F.lit(WORD))).alias("lanes"),
        (whole["n"] - part["n"]).alias("n"),
        F.zip_with(whole["counts"], part["counts"], lambda a, b: a - b).alias("counts"),
    )


def rendered(fp: Column) -> Column:
    """One string: the lanes as hexadecimal digits, the number of clauses, the counter pairs."""
    return F.concat_ws(
        ":",
        F.array_join(F.transform(fp["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        fp["n"].cast("string"),
        F.array_join(F.transform(fp["counts"], lambda x: F.lower(F.hex(x))), "."),
    )


def _dot(one: Column, other: Column) -> Column:
    """Of the signed counters. A counter c of n clauses stands for the sum 2c - n."""
    n, m = one["n"], other["n"]

    def product(a: Column, b: Column) -> Column:
        low = (F.lit(2) * a.bitwiseAND(F.lit(_LOW)) - n) * (F.lit(2) * b.bitwiseAND(F.lit(_LOW)) - m)
        return low + (F.lit(2) * F.shiftright(a, PAIR) - n) * (F.lit(2) * F.shiftright(b, PAIR) - m)

    return F.aggregate(F.zip_with(one["counts"], other["counts"], product), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the signed counters, rounded to 6 digits; negative ones count as 0."""
    norms = F.sqrt(_dot(one, one).cast("double") * _dot(other, other).cast("double"))
    same = (one["lanes"] == other["lanes"]) & (one["counts"] == other["counts"]) & (one["n"] == other["n"])
    return F.when(same, F.lit(1.0)).otherwise(
        F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(_dot(one, other) / norms, 6)))).otherwise(F.lit(0.0))
    )


def units(text: Column, kind: int) -> Column:
    """The lines and clauses of a text, as an array of struct<kind, line, clause>; one of the two is null."""
    lines = F.transform(
        F.split(text, "\\n", -1), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("line"), F.lit(None).cast("string").alias("clause"))
    )
    return F.concat(
        lines, F.transform(clauses(text), lambda c: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("line"), c.alias("clause")))
    )


def summed(rows: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """Sums the vectors of exploded units by keys and kind: the same as `fingerprint`, in generated code."""
    line, clause = F.col(f"{unit}.line"), F.col(f"{unit}.clause")
    split = rows.select(*keys, F.col(f"{unit}.kind").alias("kind"), line.alias("line"), clause.alias("clause"))
    hashed = split.select(
        *keys,
        "kind",
        F.sha2("line", 256).alias("d1"),
        F.sha2(F.concat(F.lit("2|"), F.col("line")), 256).alias("d2"),
        F.md5("clause").alias("d3"),
    )
    numbers = hashed.select(
        *keys,
        "kind",
        *[_hex(F.col("d1"), 1 + 8 * i, 8).alias(f"l{i}") for i in range(8)],
        *[_hex(F.col("d2"), 1 + 8 * i, 8).alias(f"l{8 + i}") for i in range(8)],
        _hex(F.col("d3"), 1, 15).alias("a"),
        _hex(F.col("d3"), 16, 15).alias("b"),
    )
    bits = [F.sum(F.shiftright(F.col(half), i).bitwiseAND(F.lit(_MASK))).alias(f"{half}{i}") for half in "ab" for i in range(PAIR)]
    sums = numbers.groupBy(*keys, "kind").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LANES)], F.count("a").alias("n"), *bits)
    zero = F.lit(0).cast("bigint")
    return sums.select(
        *keys,
        "kind",
        F.struct(
            F.array(*[F.coalesce(F.col(f"l{i}"), zero) % WORD for i in range(LANES)]).alias("lanes"),
            F.col("n"),
            F.array(*[F.coalesce(F.col(f"{half}{i}"), zero) for half in "ab" for i in range(PAIR)]).alias("counts"),
        ).alias("fingerprint"),
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of each row; one narrow pass, no shuffle."""
    return docs.select(F.col(key), text_or_empty(text).alias("text")).select(key, fingerprint(F.col("text")).alias("fingerprint"))


def _search(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """How many of bounds[low:high] are at most value, plus low; by halves."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < F.lit(bounds[mid]), _search(value, bounds, low, mid)).otherwise(_search(value, bounds, mid + 1, high))


def with_slots(rows: DataFrame, coarse: int = 256) -> DataFrame:
    """Adds slot, a number that doesn't fall as doc_id rises, four slots to a shuffle partition.

    `coarse` ranges at most come from approximate quantiles of doc_id; each is cut evenly into more. Rows without a doc_id
    have slots below 0, which fall as their digest rises."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(coarse, parts)
    nowhere = F.lit(-1) - F.floor(F.conv(F.substring("digest", 1, 6), 16, 10).cast("bigint") * F.lit(4 * parts) / F.lit(1 << 24)).cast("bigint")
    found = rows.approxQuantile("doc_id", [i / n for i in range(n + 1)], 0.2 / n)
    if not found:
        return rows.withColumn("slot", nowhere)
    edges = sorted({int(x) for x in found[:-1]}) + [int(found[-1]) + 1]
    fine = -(-4 * parts // n)
    at = F.greatest(F.lit(1), F.least(F.lit(len(edges) - 1), _search(F.col("doc_id"), edges, 0, len(edges))))
    ends = F.array(*[F.lit(x).cast("bigint") for x in edges])
    low, high = F.element_at(ends, F.col("range")), F.element_at(ends, F.col("range") + 1)
    inner = F.floor((F.col("doc_id") - low).cast("double") / (high - low) * fine)
    slot = F.col("range") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), inner))
    return rows.withColumn("range", at).withColumn("slot", F.coalesce(slot.cast("bigint"), nowhere)).drop("range")


def with_next(docs: DataFrame) -> DataFrame:
    """slot, doc_id, rn, text and the text of the next document by descending doc_id, after the last that of the first.

    Documents are dealt by ranges of doc_id, so no task sorts all of them; the first document of each range is the
    next of the last of the range before, and those few are looked up on their own. Rows of one doc_id are ordered
    by their text; those without one come last, by a digest of their text, which deals them evenly. after_text tells the text
    after the range's last document.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = with_slots(rows.withColumn("digest", F.when(F.col("doc_id").isNull(), F.md5("text"))))
    inside = Window.partitionBy("slot").orderBy(F.col("doc_id").desc_nulls_last(), "digest", "text")
    paired = rows.withColumn("next_text", F.lead("text").over(inside)).withColumn("rn", F.row_number().over(inside))
    # The first document of each range, and the range that comes after it: numbers only, a row for each range.
    heads = rows.groupBy(F.col("slot").alias("at")).agg(F.max("doc_id").alias("head_id"))
    ring = Window.orderBy(F.col("at").desc())
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = heads.select("at", F.coalesce(F.lead("at").over(ring), F.first("at").over(every)).alias("after_at"))
    firsts = (
        rows.join(F.broadcast(heads), (F.col("slot") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
        .groupBy(F.col("at").alias("after_at"))
        .agg(F.min(F.struct("digest", "text"))["text"].alias("after_text"))
    )
    after = order.join(firsts, "after_at").drop("after_at")
    return paired.join(after, F.col("slot") == F.col("at"), "left").drop("at", "digest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row: its fingerprint, that of its edited text, and their likeness; see `with_next`.

    The edited text has its last third replaced by as much of the next document's start. One shuffle carries the
    texts; everything after it stays in the ranges that it made."""
    n = F.char_length("text").cast("int")
    third = F.floor(n / F.lit(3)).cast("int")
    following = F.coalesce("next_text", "after_text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(following, F.lit(1), third))
    keys = ["slot", "rn", "doc_id", "n_chars", "edited_sha256"]
    rows = with_next(docs).withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    last = F.when(F.col("next_text").isNull(), F.col("after_text"))
    parts = F.concat(units(F.col("text"), 0), units(F.col("edited"), 1), F.when(last.isNull(), F.array()).otherwise(units(last, 2)))
    by_kind = summed(rows.select(*keys, F.explode(parts).alias("unit")), keys)
    each = by_kind.groupBy(*keys).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(name) for k, name in enumerate(("own", "changed", "after"))]
    )
    inside = Window.partitionBy("slot").orderBy("rn")
    each = each.withColumn("next_own", F.coalesce(F.lead("own").over(inside), F.col("after")))
    return each.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        rendered(F.col("own")).alias("fingerprint"),
        rendered(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
