"""Near-duplicate documents by b-bit MinHash.

A document's set is that of its distinct runs of five words (A-Z lower-cased, words between ASCII white space); with
fewer words, the one run of all; without words, nothing, and such a document is linked with none.

1. Documents with equal sets form a class, which has a number of its own; what follows is between classes, so it doesn't
   depend on doc_ids being there or being different.
2. BANDS x ROWS minima of each set make band keys, and the low B bits of each minimum a packed signature.
3. Classes in a band's bucket are paired with that of the smallest doc_id, the hub. A pair is a candidate if set sizes allow
   the wanted similarity and the bit counts of the signatures, corrected for chance collisions, estimate it within
   SLACK (over five standard errors).
4. Candidates are confirmed on the full sets, and links make components.
5. Documents of buckets that hold more than one component after that meet in an exact prefix join of their sets,
   across components only; what it finds is confirmed likewise, and a further pass of components ends it. So a large
   group of copies costs a pair per member, and a link between components isn't skipped for being off the hub.

Two sets of similarity 0.85 share no band with a probability of 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import discard, materialised, shipped, text_or_empty
from corpusgate.llm.components import components
from corpusgate.llm.wordhash import blocks, hashed_words, mixed, odd_numbers

SHINGLE = 5
PERCENT = 85
BANDS = 26
ROWS = 6
B = 4
SLACK = 0.16
#: Identifiers, of 8 bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Hashes of a set that go through all permutations at once; bounds memory on long texts.
_STEP = 2048
#: What tells sets apart, and what tells texts apart.
EQUAL = ["n_shingles", "set_a", "set_b"]
TEXT = ["text_a", "text_b"]
_SKETCH = "doc_id bigint, text_a bigint, text_b int, n_shingles bigint, set_a bigint, set_b bigint, signature binary, bands array<bigint>"
_SETS = "n_shingles bigint, set_a bigint, set_b bigint, shingles array<bigint>"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted."""
    words, offsets = hashed_words(texts)
    out = []
    factors = odd_numbers(SHINGLE, 2)
    with np.errstate(over="ignore"):
        n = len(words) - SHINGLE + 1
        runs = mixed(sum(words[i : i + n] * factors[i] for i in range(SHINGLE))) if n > 0 else words[:0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mixed((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(words[:0])
    return out


def _minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), ~np.uint64(0))
    for i in range(0, len(hashes), _STEP):
        spread = np.multiply.outer(factors, hashes[i : i + _STEP])
        spread += shifts[:, None]
        np.minimum(out, spread.min(axis=1), out=out)
    return out


def _identity(hashes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that are equal for equal sets."""
    return mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), mixed(hashes + np.uint64(0x1234567887654321)).sum()


def _bits(values: list[np.uint64]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BANDS * ROWS
    factors, shifts, band, row = odd_numbers(k, 3), odd_numbers(k, 4), odd_numbers(BANDS, 5), odd_numbers(ROWS, 6)
    for batch in batches:
        for first, texts in blocks(batch.column(3)):
            sizes, set_a, set_b, signatures, keys = [], [], [], [], []
            with np.errstate(over="ignore"):
                for hashes in shingle_sets(texts):
                    sizes.append(len(hashes))
                    one, other = _identity(hashes)
                    set_a.append(one)
                    set_b.append(other)
                    if not len(hashes):
                        signatures.append(None)
                        keys.append(None)
                        continue
                    low = _minima(hashes, factors, shifts)
                    bits = (mixed(low) & np.uint64((1 << B) - 1)).astype(np.uint8)
                    signatures.append(np.packbits(np.unpackbits(bits[:, None], axis=1)[:, 8 - B :]).tobytes())
                    keys.append(mixed((low.reshape(BANDS, ROWS) * row).sum(axis=1) + band).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(first, len(texts)) for i in range(3)],
                    pa.array(sizes, pa.int64()),
                    _bits(set_a),
                    _bits(set_b),
                    pa.array(signatures, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", *TEXT, *EQUAL, "signature", "bands"],
            )


def text_keys(text: str = "text") -> list[Column]:
    """TEXT: 96 bits of a text, by which rows are found again; nulls count as empty."""
    value = text_or_empty(text)
    return [F.xxhash64(value).alias("text_a"), F.hash(value).alias("text_b")]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, set_a and set_b (128 bits that are equal for equal sets), signature, bands."""
    rows = shipped(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_keys(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketched, _SKETCH)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in blocks(batch.column(0)):
            with np.errstate(over="ignore"):
                sets = shingle_sets(texts)
                marks = [_identity(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(x) for x in sets], pa.int64()),
                    _bits([x for x, _ in marks]),
                    _bits([x for _, x in marks]),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                [*EQUAL, "shingles"],
            )


def estimate(one: Column, other: Column) -> Column:
    """Similarity from two packed signatures: the share of equal B-bit groups, less what chance makes equal."""
    k = BANDS * ROWS
    # A group differs if one of its bits does: fold the bits of the difference onto each group's lowest, then count.
    parts = []
    for at in range(0, k * B // 8, 4):
        n = min(4, k * B // 8 - at)
        number = lambda c: F.conv(F.hex(F.substring(c, at + 1, n)), 16, 10).cast("bigint")  # noqa: B023, E731
        x = number(one).bitwiseXOR(number(other))
        folded = x
        for i in range(1, B):
            folded = folded.bitwiseOR(F.shiftright(x, i))
        parts.append(F.bit_count(folded.bitwiseAND(F.lit(int("1" * (8 * n // B), 1 << B)))))
    differing = sum(parts[1:], parts[0])
    chance = 1 / (1 << B)
    return ((1 - differing / F.lit(float(k))) - chance) / (1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs that sizes and signatures don't rule out."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v")
    fits = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    return both.filter(fits).filter(estimate(F.col("s_u"), F.col("s_v")) >= percent / 100 - SLACK).select("u", "v", "n_u", "n_v")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    links = both.select("u", "v", "n_u", "n_v", F.size(F.array_intersect("set_u", "set_v")).alias("shared"))
    return links.filter(F.col("shared") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("shared")) * percent).select("u", "v")


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that prefixes don't rule out; rest has rep and component.

    Each set is put in one order for all: shingles that only one component has, then the rarer before the more
    frequent. Of two similar sets the first ones can't all be unshared, so some shingle of both short prefixes is the
    same, and at their first such shingle enough must be left of both to reach the wanted overlap. No pair of
    similar sets is lost. Shingles of one component only are counted, never joined, and members of the component that has most
    of a shingle's documents are never compared with each other: each pair has a document of another one, which looks for it."""
    rows = sets.join(rest, "rep").select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    spread = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = materialised(rows.join(spread.filter("low < high").select("shingle", "df"), "shingle"), "neardup-shared")
    # A set needs this many shingles in common with another, whatever its size.
    needed = F.ceil(F.col("n") * percent / 100)
    held = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("of")).filter(F.col("m") >= F.ceil(F.col("of") * percent / 100))
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    ranked = shared.join(held.drop("of"), "rep").withColumn("place", F.col("n") - F.col("m") + F.row_number().over(order))
    prefix = materialised(ranked.filter(F.col("place") <= F.col("n") - needed + 1), "neardup-prefixes")
    discard(shared)
    most = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("shingle")
    most = most.agg(F.max(F.struct("held", "component"))["component"].alias("most"))
    side = lambda c: prefix.select(
        "shingle", F.col("rep").alias(c), F.col("component").alias(f"c_{c}"), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"p_{c}")
    )
    left = F.least(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v")) + 1
    enough = left * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent
    asking = side("u").join(most, "shingle").filter("c_u <> most")
    return asking.join(side("v"), "shingle").filter("c_u <> c_v and (c_v = most or u < v)").filter(enough).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def linked_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows: doc_id, text_a, text_b, n_shingles, set_a, set_b of each row of docs. Classes that have several rows or a link: n_shingles,
    set_a, set_b, members, component (a number) and component_id (the smallest doc_id in it, null if none has one)."""
    marks = materialised(sketches(docs), "neardup-sketches")
    classes = marks.filter(F.col("n_shingles") > 0).groupBy(*EQUAL)
    # Rows of equal sets have equal signatures and bands.
    classes = classes.agg(
        F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("doc_id"), F.min(F.struct(*TEXT)).alias("of"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    reps = materialised(classes.withColumn("rep", F.monotonically_increasing_id()), "neardup-classes")
    # The hub is the class with the smallest doc_id: copies come after what they are copies of.
    members = reps.select("rep", "doc_id", F.explode("bands").alias("band"))
    hub = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep"))["rep"]
    buckets = members.groupBy("band").agg(hub.alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    placed = materialised(members.drop("doc_id").join(buckets, "band"), "neardup-buckets")
    first = placed.filter("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v"))
    # Few documents share a bucket. Up to BROADCAST_IDS of them are sent around, so that only their texts are dealt.
    wanted = materialised(reps.join(placed.select("rep").distinct(), "rep", "left_semi").select("rep", *EQUAL, "of.*"), "neardup-wanted")
    keys = wanted.select(*TEXT)
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_IDS else keys
    texts = shipped(docs).select(*text_keys(), F.col("text").cast("string").alias("text")).join(keys, TEXT, "left_semi").dropDuplicates(TEXT)
    sets = texts.select("text").mapInArrow(_set_rows, _SETS).join(wanted.drop(*TEXT), EQUAL).select("rep", "shingles")
    sets = materialised(sets, "neardup-sets")
    links = materialised(_confirmed(_likely(first, reps, percent), sets, percent), "neardup-links")
    labels = components(links)

    # What is left: buckets of three and more that still hold several components.
    labelled = placed.filter("held > 2").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    split = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    split = materialised(split.select("band"), "neardup-split")
    split = F.broadcast(split) if split.count() <= BROADCAST_IDS else split
    rest = labelled.join(split, "band", "left_semi").select("rep", "component").distinct()
    rest = materialised(rest, "neardup-rest")
    done = [wanted, placed, sets, links, rest]
    if not rest.isEmpty():
        more = materialised(_confirmed(_likely(_across(rest, sets, percent), reps, percent), sets, percent), "neardup-more")
        # The components so far take part as links of their members.
        done += [more, labels]
        labels = components(more.unionByName(labels.filter("id <> component").select(F.col("component").alias("u"), F.col("id").alias("v"))))
    found = reps.drop("signature", "bands", "of").join(labels.withColumnRenamed("id", "rep"), "rep", "left").filter("members > 1 or component is not null")
    found = found.withColumn("component", F.coalesce("component", "rep"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = materialised(found.drop("doc_id").join(least, "component").select(*EQUAL, "members", "component", "component_id"), "neardup-components")
    discard(*done, labels, reps)
    return marks.drop("signature", "bands"), found


def of_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Left join of rows and their class. Up to BROADCAST_IDS classes are broadcast. Beyond it only the largest are, each with more
    than an even share of the rows for so many, so that none of those that are dealt is hot."""
    if classes.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(classes), EQUAL, "left")
    hot = F.col("members") > F.lit(rows.count() // BROADCAST_IDS)
    large = F.broadcast(classes.filter(hot))
    rest = rows.join(large, EQUAL, "left_anti")
    dealt = rest.filter("n_shingles > 0").join(classes.filter(~hot), EQUAL, "left")
    return rows.join(large, EQUAL).unionByName(dealt).unionByName(rest.filter("n_shingles = 0"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    component_id is the smallest doc_id that links reach, its own for a document without links; kept tells whether
    that is the row's own. Links are between texts, row by row: rows that repeat a doc_id with different texts may be in different
    components, equal rows have equal answers. A row without a doc_id takes part in links; it is kept only where no row that links
    reach has one, and component_id is null then."""
    rows, classes = linked_classes(docs, percent)
    out = of_rows(rows.drop(*TEXT), classes.drop("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    out = out.select("doc_id", "n_shingles", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", kept)


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id, rows without one last, and of those
    with equal doc_ids and texts one. Documents without words stay. Columns neardup_text_a and neardup_text_b of docs go."""
    rows, classes = linked_classes(docs, percent)
    rows = of_rows(rows, classes.select(*EQUAL, "members", "component"))
    of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *TEXT)
    grouped = rows.filter("members is not null")
    first = grouped.groupBy("component").agg(F.min(of).alias("of")).select("of.*").drop("none")
    first = materialised(first.withColumnRenamed("doc_id", "first_id"), "neardup-first")
    # Texts of components; each of them goes but for its first row.
    several = materialised(grouped.select(*TEXT).distinct(), "neardup-several")
    own = [f"neardup_{c}" for c in TEXT]
    marked = docs.drop(*own).select("*", *[key.alias(name) for key, name in zip(text_keys(), own, strict=True)])
    same = lambda other: [marked[name] == other[c] for name, c in zip(own, TEXT, strict=True)]
    small = several.count() <= BROADCAST_IDS
    sent = F.broadcast if small else lambda df: df
    single = marked.join(sent(several), same(several), "left_anti")
    chosen = marked.join(sent(first), [*same(first), marked["doc_id"].eqNullSafe(first["first_id"])], "left_semi")
    return single.unionByName(chosen.dropDuplicates(["doc_id", *own])).drop(*own)
