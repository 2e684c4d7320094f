"""Secret scans: fixed patterns, and windows of high entropy in strings that look random.

Patterns (kinds assign, access and hex) are matched leftmost and without overlap, each kind on its own. Candidate
strings of three further kinds are read window by window; a string is reported if the Shannon entropy of one of its
windows reaches its class's threshold:

- b64: runs of letters, digits, ``+ / _ -``, which have a digit, an upper-case and a lower-case letter;
- upper: runs of digits and A-Z, which have both;
- lower: runs of digits and a-z, which have both, where no string of the other two is reported.

Each window's entropy comes from counts that change by one character in and one out, H = log2 W - S / W with
S = sum of c log2 c. Left out are UUIDs, words between separators (a number may end them), strings that are shorter than a
window without their placeholders, and those that a pattern has found. Null text counts as empty. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.arrays import let, literal, running, running_sum
from corpusgate.llm.common import text_or_empty

_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_HEAD = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
#: kind: pattern, the start of a match that doesn't count towards its least length, that length.
PATTERNS = {
    "assign": (_HEAD + "[A-Za-z0-9+/_.=-]+", "^" + _HEAD, 12),
    "access": ("AKIA[A-Z0-9]+", "", 18),
    "hex": ("[0-9a-f]{16,}", "", 16),
}
WINDOW = 20
#: kind: candidate strings, what they must contain, the least entropy of a window in bits.
CLASSES = {
    "b64": ("[A-Za-z0-9+/_-]{20,}", ("[0-9]", "[A-Z]", "[a-z]"), 3.75),
    "upper": ("[A-Z0-9]{20,}", ("[0-9]", "[A-Z]"), 3.5),
    "lower": ("[a-z0-9]{20,}", ("[0-9]", "[a-z]"), 3.5),
}
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Each string fits in one way at most, so nothing is given back (++): long ones need no stack.
_WORD = "(?:[A-Z]?+[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
_WORDS = f"^[/_+-]*+(?:{_WORD}[/_+-]++)++(?:{_WORD})?+[0-9]{{0,4}}$"
#: Words count as whole segments only; runs anywhere.
_PLACEHOLDER = "(?i)(?<![a-z0-9])(?:example|sample|placeholder|changeme|dummy|test)(?![a-z0-9])|x{4,}|0123456789|abcdefgh[i-z]*"
#: What the SQL to compare with leaves out; wider than allowed(), as prefixed tokens match it too.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|placeholder|changeme|dummy|test|xxxx|0123456789|abcdefgh",
    "^[/_+-]*(?:[A-Za-z]+[/_+-]+)+[A-Za-z0-9]*$",
)
#: What every span holds: a run that is long enough, or a value after a sign.
_ANY = r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}|[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
#: Characters of a candidate that are walked at a time.
BLOCK = 100
_FAR = 2**31 - 1
ORDER = [*PATTERNS, *CLASSES]
_SPAN = "array<struct<start:int,place:int,kind:string,end:int,found:string>>"


def _spans(text: str, kind: str, pattern: str, keep: str = "true") -> str:
    """Matches m of a pattern with their places, those that `keep` holds for. The gaps between matches come from splitting at them."""
    asked = literal(pattern)
    sizes = f"zip_with(found, slice(split({text}, {asked}, -1), 1, size(found)), (m, gap) -> CAST(char_length(gap) + char_length(m) AS BIGINT))"
    place = f"named_struct('start', CAST(stop AS INT) - char_length(m), 'place', {ORDER.index(kind)}, 'kind', '{kind}', 'end', CAST(stop AS INT), 'found', m)"
    placed = let("found", f"regexp_extract_all({text}, {asked}, 0)", f"zip_with(found, {running_sum(sizes)}, (m, stop) -> {place})")
    return f"CASE WHEN {text} RLIKE {asked} THEN filter({placed}, m -> {keep}) ELSE CAST(array() AS {_SPAN}) END"


def base_spans(text: str = "text") -> str:
    """The spans of PATTERNS in order of start, then kind as listed."""
    found = []
    for kind, (pattern, head, least) in PATTERNS.items():
        value = f"regexp_replace(m.found, {literal(head)}, '')" if head else "m.found"
        found.append(_spans(text, kind, pattern, f"char_length({value}) >= {least}"))
    return f"array_sort(concat({', '.join(found)}))"


def candidates(kind: str, text: str = "text") -> str:
    """Strings of one of CLASSES, without allowed ones."""
    pattern, needed, _ = CLASSES[kind]
    rest = f"char_length(regexp_replace(m.found, {literal(_PLACEHOLDER)}, ''))"
    allowed = [f"m.found RLIKE {literal(_UUID)}", f"m.found RLIKE {literal(_WORDS)}", f"m.found RLIKE {literal(_PLACEHOLDER)} AND {rest} < {WINDOW}"]
    return _spans(text, kind, pattern, " AND ".join([f"m.found RLIKE '{p}'" for p in needed] + [f"NOT ({x})" for x in allowed]))


def clear_of(found: str, others: str) -> str:
    """Those of the spans that overlap none of the others, in order of start. Both are names of columns.

    Both are put in one order; a span is clear if no other that starts before or with it ends after its start, and
    none that starts after it does so before its end."""
    tagged = lambda spans, other: f"transform({spans}, m -> named_struct('start', m.start, 'other', {other}, 'm', m))"
    every = f"array_sort(concat({tagged(found, 'false')}, {tagged(others, 'true')}))"
    before = running("transform(every, e -> CASE WHEN e.other THEN e.m.end ELSE -1 END)", "greatest(x, y)", "-1")
    after = running(f"reverse(transform(every, e -> CASE WHEN e.other THEN e.m.start ELSE {_FAR} END))", "least(x, y)", str(_FAR))
    marked = f"zip_with(zip_with(every, {before}, (e, b) -> named_struct('e', e, 'b', b)), reverse({after}), (z, a) -> named_struct('e', z.e, 'b', z.b, 'a', a))"
    clear = f"transform(filter({marked}, z -> NOT z.e.other AND z.b <= z.e.m.start AND z.a >= z.e.m.end), z -> z.e.m)"
    return f"CASE WHEN size({found}) > 0 AND size({others}) > 0 THEN {let('every', every, clear)} ELSE {found} END"


def highest_entropy(string: str, window: int = WINDOW) -> str:
    """The greatest entropy of a window of an ASCII string, 0 if it is shorter than a window.

    State: counts by character, S = sum of c log2 c, the least S of a full window so far. A count n is the letter of
    code 65 + n in a string, so that a change copies some bytes."""
    c_log_c = "array(0D, " + ", ".join(f"{c}D * log2({c}D)" for c in range(1, window + 2)) + ")"
    worst = f"{window * 64}D"

    def moved(acc: str, at: str, by: int) -> str:
        counts = f"overlay({acc}.counts PLACING char(old + {65 + by}) FROM element_at(codes, {at}) FOR 1)"
        change = f"element_at({c_log_c}, old + {by + 1}) - element_at({c_log_c}, old + 1)"
        state = f"named_struct('counts', {counts}, 's', {acc}.s + {change}, 'least', {acc}.least)"
        return let("old", f"ascii(substring({acc}.counts, element_at(codes, {at}), 1)) - 65", state)

    # The character that leaves goes first, so counts never exceed the window.
    less = f"CASE WHEN i > {window} THEN {moved('acc', f'i - {window}', -1)} ELSE acc END"
    least = f"CASE WHEN i >= {window} THEN least(now.least, now.s) ELSE now.least END"
    step = let("now", let("less", less, moved("less", "i", 1)), f"named_struct('counts', now.counts, 's', now.s, 'least', {least})")
    start = f"named_struct('counts', repeat('A', 127), 's', 0D, 'least', {worst})"
    walked = let("codes", f"transform(split({string}, ''), c -> ascii(c))", f"aggregate(sequence(1, size(codes)), {start}, (acc, i) -> {step}, acc -> acc.least)")
    return let("low", walked, f"CASE WHEN low < {worst} THEN log2({window}D) - low / {window}D ELSE 0D END")


def reaches(string: str, entropy: float, window: int = WINDOW) -> str:
    """Whether a window of the string has so much entropy.

    A long string goes through in blocks that overlap by a window less one, up to the first that has it. A block with too few
    distinct characters for that entropy isn't walked."""
    enough = math.ceil(2**entropy - 1e-9)
    full = f"element_at(blocks, at) || substring(coalesce(try_element_at(blocks, at + 1), ''), 1, {window - 1})"
    high = f"CASE WHEN size(array_distinct(split(block, ''))) >= {enough} THEN {highest_entropy('block', window)} >= {entropy}D ELSE false END"
    any_block = f"exists(sequence(1, size(blocks)), at -> {let('block', full, high)})"
    blocks = f"regexp_extract_all({string}, '.{{1,{BLOCK}}}', 0)"
    return f"CASE WHEN char_length({string}) >= {window} THEN {let('blocks', blocks, any_block)} ELSE false END"


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and entropy, arrays of struct<start, place, kind, end, found>; one narrow pass.

    Texts without a run that could be of any kind aren't searched kind by kind."""
    rows = docs.select(F.col(key), text_or_empty(text).alias("text"))
    rows = rows.withColumn("text", F.when(F.col("text").rlike(_ANY), F.col("text")).otherwise(""))
    # What a step names more than once is a column by then.
    rows = rows.select(key, F.expr(base_spans()).alias("base"), *[F.expr(candidates(k)).alias(k) for k in CLASSES])
    rows = rows.select(key, "base", *[F.expr(clear_of(k, "base")).alias(k) for k in CLASSES])
    high = lambda kind: F.expr(f"filter({kind}, m -> {reaches('m.found', CLASSES[kind][2])})")
    rows = rows.select(key, "base", *[high(k).alias(k) for k in CLASSES])
    # Of candidates that reach their entropy, those inside of a wider one are part of it.
    rows = rows.select(key, "base", "b64", "lower", F.expr(clear_of("upper", "b64")).alias("upper"))
    rows = rows.select(key, "base", F.concat("b64", "upper").alias("wider"), "lower")
    return rows.select(key, "base", F.concat("wider", F.expr(clear_of("lower", "wider"))).alias("entropy"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row."""
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id",
        *[count(k) for k in PATTERNS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
