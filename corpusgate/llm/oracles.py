"""SQL for DuckDB that gives the rows of those queries that SQL can express, over whole tables.

None for op4 and op10 (trained models), op6 (merges in order of rank) and the pipeline; tests/llm holds brute-force versions."""

from __future__ import annotations

from corpusgate.llm import fingerprints, licenses, mixing, secrets, sharding

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = "'[^\\x20\\x09-\\x0D]+'"
PLAIN = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"


def _hex(digest: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {n}) AS BIGINT)"


def _fingerprint(text: str) -> str:
    """struct of lanes, n, counts, as in fingerprints.fingerprint."""
    lines = f"string_split({text}, chr(10))"
    cut = f"string_split(regexp_replace(c, '{fingerprints._ENDS}', '\\1' || chr(10), 'g'), chr(10))"
    parts = f"flatten(list_transform(string_split_regex({text}, '[.,;:!?\\n]'), lambda c: CASE WHEN length(c) > {fingerprints.LONG} THEN {cut} ELSE [c] END))"
    clauses = f"list_filter(list_transform({parts}, lambda c: trim(c)), lambda c: c <> '')"
    lanes = [f"CAST(list_sum(list_transform({lines}, lambda p: {_hex('sha256(p)', 1 + 8 * i, 8)})) % {fingerprints.WORD} AS BIGINT)" for i in range(8)]
    lanes += [f"CAST(list_sum(list_transform({lines}, lambda p: {_hex("sha256('2|' || p)", 1 + 8 * i, 8)})) % {fingerprints.WORD} AS BIGINT)" for i in range(8)]
    mask = (1 << fingerprints.PAIR) | 1
    halves = []
    for start in (1, 16):
        hashes = f"list_transform({clauses}, lambda c: {_hex('md5(c)', start, 15)})"
        halves.append(
            f"list_transform(range({fingerprints.PAIR}), lambda s: CAST(coalesce(list_sum(list_transform({hashes}, lambda h: (h >> s::INT) & {mask})), 0) AS BIGINT))"
        )
    return f"{{'lanes': [{', '.join(lanes)}], 'n': CAST(len({clauses}) AS BIGINT), 'counts': {halves[0]} || {halves[1]}}}"


def _rendered(fp: str) -> str:
    return (
        f"array_to_string(list_transform({fp}.lanes, lambda x: lpad(lower(to_hex(x)), 8, '0')), '') || ':' || CAST({fp}.n AS VARCHAR) || ':' || "
        f"array_to_string(list_transform({fp}.counts, lambda x: lower(to_hex(x))), '.')"
    )


def _dot(a: str, b: str) -> str:
    low = (1 << fingerprints.PAIR) - 1
    return (
        f"CAST(list_sum(list_transform(list_zip({a}.counts, {b}.counts), lambda p: (2 * (p[1] & {low}) - {a}.n) * (2 * (p[2] & {low}) - {b}.n) "
        f"+ (2 * (p[1] >> {fingerprints.PAIR}) - {a}.n) * (2 * (p[2] >> {fingerprints.PAIR}) - {b}.n))) AS BIGINT)"
    )


def _likeness(a: str, b: str) -> str:
    norms = f"sqrt(CAST({_dot(a, a)} AS DOUBLE) * CAST({_dot(b, b)} AS DOUBLE))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {norms} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, round({_dot(a, b)} / {norms}, 6))) ELSE 0.0::DOUBLE END"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, CASE WHEN doc_id IS NULL THEN md5(text) END, text)),
e AS (SELECT doc_id, text, following, CAST(length(text) AS BIGINT) AS n_chars,
  substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM o),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_fingerprint('text')} AS a, {_fingerprint('edited')} AS b, {_fingerprint('following')} AS c FROM e)
SELECT doc_id, n_chars, edited_sha256, {_rendered('a')} AS fingerprint, {_rendered('b')} AS edited_fingerprint, {_likeness('a', 'b')} AS near_edited, {_likeness('a', 'c')} AS near_next FROM f"""

OP2 = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS BIGINT) AS size,
  {_hex(f"md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'text|' || coalesce(text, '')))", 1, 12)} / 281474976710656.0 AS place FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([{', '.join(f'{w}.0::DOUBLE' for w in mixing.WEIGHTS)}], (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1) AS weight
  FROM s GROUP BY source),
l AS (SELECT *, source_size * {float(mixing.EPOCHS)}::DOUBLE AS cap, sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS budget FROM b),
g AS (SELECT *, sum(cap) OVER w - cap AS filled, sum(weight) OVER () - sum(weight) OVER w + weight AS opened FROM l WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, cap / weight * opened + filled <= budget AS filled_up FROM g),
t AS (SELECT source, source_size, CASE WHEN filled_up THEN cap ELSE weight * ((budget - coalesce(sum(cap) FILTER (filled_up) OVER (), 0.0)) / sum(weight) FILTER (NOT filled_up) OVER ()) END AS target FROM h),
q AS (SELECT s.doc_id, s.size, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST({' + '.join(
    f"round(least(CAST({i} * source_size + upto AS DOUBLE), target)) - round(least(CAST({i} * source_size + upto - size AS DOUBLE), target))" for i in range(mixing.EPOCHS)
)} AS BIGINT) AS taken FROM q"""


def op3(limit: int) -> str:
    """Prefix by prefix: a prefix is split while its bytes exceed the limit and its codes differ."""
    digits = f"substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || '|' || coalesce(text, chr(0))), 1, {sharding.BITS // 4})"
    bits = f"lpad(format('{{:b}}', {_hex(digits, 1, 15)}), {sharding.BITS}, '0')"
    return f"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS r, doc_id, {bits} AS code, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
walk AS (SELECT r, doc_id, code, bytes, 0 AS depth, sum(bytes) OVER () AS held, min(code) OVER () = max(code) OVER () AS same FROM c
  UNION ALL SELECT r, doc_id, code, bytes, depth + 1, sum(bytes) OVER w, min(code) OVER w = max(code) OVER w FROM walk WHERE held > {limit} AND NOT same AND depth < {sharding.BITS}
  WINDOW w AS (PARTITION BY substr(code, 1, depth + 1)))
SELECT doc_id, substr(code, 1, depth) AS shard, CAST(held AS BIGINT) AS shard_bytes, held > {limit} AS oversized FROM walk
WHERE held <= {limit} OR same OR depth = {sharding.BITS}"""


def _spans(kind: str, pattern: str, least: str = "true") -> str:
    """A subquery of doc_id, start, place, kind, stop: the gaps between matches give their places."""
    quoted = pattern.replace("'", "''")
    return f"""(SELECT doc_id, CAST(starts[i] AS BIGINT) AS start, {secrets.ORDER.index(kind)} AS place, '{kind}' AS kind, CAST(starts[i] + length(found[i]) AS BIGINT) AS stop, found[i] AS found
  FROM (SELECT doc_id, found, list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0)) AS starts
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}') AS found, string_split_regex(coalesce(text, ''), '{quoted}') AS gaps FROM documents) WHERE len(found) > 0), unnest(range(1, len(found) + 1)) AS u(i)
  WHERE {least})"""


def _entropy(kind: str) -> str:
    pattern, needed, _ = secrets.CLASSES[kind]
    checks = [f"regexp_matches(found, '{p}')" for p in needed] + [f"NOT regexp_matches(found, '{p}')" for p in secrets.ALLOWED]
    return f"(SELECT * FROM {_spans(kind, pattern)} AS x WHERE {' AND '.join(checks)} AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop))"


_ASSIGN, _HEAD, _ = secrets.PATTERNS["assign"]
_HEAD_SQL = _HEAD.replace("'", "''")
_WINDOW = secrets.WINDOW
OP5 = f"""
WITH base AS (SELECT * FROM {_spans('assign', _ASSIGN, f"length(regexp_replace(found[i], '{_HEAD_SQL}', '')) >= 12")}
  UNION ALL SELECT * FROM {_spans('access', secrets.PATTERNS['access'][0], 'length(found[i]) >= 18')} UNION ALL SELECT * FROM {_spans('hex', secrets.PATTERNS['hex'][0])}),
narrow AS (SELECT * FROM {_entropy('upper')}), wide AS (SELECT * FROM {_entropy('b64')}),
maybe AS (SELECT * FROM narrow UNION ALL SELECT * FROM wide),
chars AS (SELECT doc_id, start, place, kind, stop, w, substr(found, w + k, 1) AS c FROM maybe, unnest(range(1, length(found) - {_WINDOW} + 2)) AS a(w), unnest(range({_WINDOW})) AS b(k)),
counts AS (SELECT doc_id, start, place, kind, stop, w, c, count(*) AS n FROM chars GROUP BY ALL),
windows AS (SELECT doc_id, start, place, kind, stop, w, log2({_WINDOW}.0) - sum(n * log2(n)) / {_WINDOW} AS h FROM counts GROUP BY ALL),
high AS (SELECT doc_id, start, place, kind, stop FROM windows GROUP BY ALL HAVING max(h) >= CASE kind WHEN 'b64' THEN {secrets.CLASSES['b64'][2]} ELSE {secrets.CLASSES['upper'][2]} END),
extra AS (SELECT * FROM high AS x WHERE kind = 'b64' OR NOT EXISTS (SELECT 1 FROM high AS b WHERE b.kind = 'b64' AND b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop)),
each AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS base FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM (SELECT doc_id, start, place, kind, stop FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN each USING (doc_id) LEFT JOIN every USING (doc_id)"""

_POSTINGS = ", ".join(f"({n}, {i}, '{w}')" for n, words in enumerate(licenses.WORDS) for i, w in enumerate(words))
_KEYS = ", ".join(f"({n}, '{label}', [{', '.join(repr(f' {k} ') for k in keys)}])" for n, (label, keys, _) in enumerate(licenses.TEXTS))
_PHRASES = " UNION ALL ".join(
    f"SELECT r, CAST(i - 1 AS BIGINT) AS start, '{label}' AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE words[i:i + {len(phrase.split()) - 1}] = {phrase.split()}"
    for phrase, label in licenses.PHRASES.items()
)
OP7 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {PLAIN}) AS words FROM documents),
p AS (SELECT * FROM (VALUES {_POSTINGS}) AS t(notice, position, word)), k AS (SELECT * FROM (VALUES {_KEYS}) AS t(notice, label, keys)),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM w) WHERE word IN (SELECT word FROM p) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1.0) / coalesce(df, 1)) AS idf FROM (SELECT DISTINCT word FROM p) LEFT JOIN df USING (word)),
shares AS (SELECT notice, position, word, CAST(round({licenses.UNIT} * idf / sum(idf) OVER (PARTITION BY notice)) AS BIGINT) AS share FROM p JOIN idf USING (word)),
pairs AS (SELECT a.notice, a.position, a.word, b.word AS next FROM p AS a JOIN p AS b ON b.notice = a.notice AND b.position = a.position + 1),
places AS (SELECT r, i - 1 AS here, words[i] AS word, words[i + 1] AS next FROM w, unnest(range(1, len(words))) AS u(i) WHERE words[i] IN (SELECT word FROM p)),
stands AS (SELECT r, notice, here - position AS start, position FROM places JOIN pairs USING (word, next)),
bands AS (SELECT DISTINCT r, notice, start, start + greatest(4, n // 4) AS stop FROM stands JOIN (SELECT notice, count(*) AS n FROM p GROUP BY notice) USING (notice)),
covered AS (SELECT b.r, b.notice, b.start, s.position + j AS position FROM bands AS b JOIN stands AS s ON s.r = b.r AND s.notice = b.notice AND s.start >= b.start AND s.start < b.stop, unnest([0, 1]) AS u(j)
  UNION SELECT b.r, b.notice, b.start, p.position FROM bands AS b JOIN p USING (notice) JOIN w USING (r) WHERE b.start + p.position >= 0 AND words[b.start + p.position + 1] = p.word),
aligned AS (SELECT r, notice, start, sum(share) AS share FROM covered JOIN shares USING (notice, position) GROUP BY ALL HAVING sum(share) >= {licenses.SCORE} * {licenses.UNIT}),
sure AS (SELECT r, label, max(share) AS share FROM aligned JOIN k USING (notice) JOIN w USING (r)
  WHERE len(list_filter(keys, lambda x: NOT contains(' ' || array_to_string(words, ' ') || ' ', x))) = 0 GROUP BY ALL),
ph AS ({_PHRASES}),
b AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM ph GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM ph UNION ALL SELECT r, label FROM sure) GROUP BY r),
m AS (SELECT r, max(share) AS share FROM sure GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, coalesce(CAST(m.share AS DOUBLE) / {float(licenses.UNIT)}::DOUBLE, 0.0)) END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN m USING (r)"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT e.v, reach.r FROM reach JOIN edges AS e ON e.u = reach.u),
c AS (SELECT u AS doc_id, min(r) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, {PLAIN}) AS words FROM documents), i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, {PLAIN}) AS words FROM benchmark),
t AS (SELECT DISTINCT item, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 10 THEN [words] ELSE list_transform(range(1, len(words) - 8), lambda k: words[k:k + 9]) END) AS win FROM i),
m AS (SELECT DISTINCT len(win) AS m FROM t),
d AS (SELECT doc_id, k, words[k:k + m - 1] AS win FROM w, m, unnest(range(1, greatest(len(words) - m + 2, 1))) AS u(k)),
h AS (SELECT doc_id, k, len(win) AS m, item FROM d JOIN t USING (win)),
hits AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, unnest(range(m)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
