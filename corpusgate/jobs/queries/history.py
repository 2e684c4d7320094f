"""Queries of commits, branches, identities and prose; orders of customers taken as commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.text import explode_lines, sanitize_ascii
from corpusgate.operators import commits as C
from corpusgate.operators import prose
from corpusgate.sources.synth import table, view, with_views

_SHAPE = "regexp_matches(bare, '^(?:feat|fix|chore|docs|test|ci): \\S.*$')"
_BARE = "regexp_replace(subject, ' \\(#[0-9]+\\)$', '')"


def _subject_sql(malformed: str, long: str, period: str, keys: str, source: str) -> str:
    rows = f"(SELECT {keys}, {_BARE} AS bare FROM {source})"
    return (
        f"SELECT {keys}, '{malformed}' AS violation FROM {rows} WHERE NOT {_SHAPE} UNION ALL SELECT {keys}, '{long}' FROM {rows} WHERE {_SHAPE} AND length(bare) > 50 "
        f"UNION ALL SELECT {keys}, '{period}' FROM {rows} WHERE {_SHAPE} AND ends_with(bare, '.')"
    )


#: Trailers by seq modulo 8, from how the view makes bodies.
_TRAILERS = """(SELECT repo, sha, seq, author_login, t.n, t.key, t.value FROM commits JOIN (VALUES (0, 0, 'Co-authored-by', 'Helper Agent'), (1, 0, 'Signed-off-by', 'A <a@b.io>'),
  (1, 1, 'co-authored-by', 'Ann <ann@b.io>'), (2, 0, 'Co-authored-by', 'Bob' || chr(10) || '<bob@b.io>'), (4, 0, 'Co-authored-by', 'xAI <dev@x.ai>'),
  (6, 0, 'Co-Authored-By', '<no@name.io>'), (7, 0, 'Refs', '1')) AS t(k, n, key, value) ON seq % 8 = t.k)"""
_DENIED = """(regexp_matches(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'grok|xai') OR regexp_matches(regexp_replace(split_part(lower(email), '@', 1), '[^a-z0-9]', '', 'g'), 'grok|xai')
  OR regexp_matches(CASE WHEN contains(email, '@') THEN split_part(lower(email), '@', -1) ELSE '' END, '(^|\\.)x\\.ai$'))"""
_NOREPLY = "(?i)^(?:[0-9]+\\+)?[A-Za-z0-9-]+(?:\\[bot\\])?@users\\.noreply\\.github\\.com$"
_NUMBERED = "(?i)^([0-9]+)\\+([A-Za-z0-9-]+)@users\\.noreply\\.github\\.com$"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "commits")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.title_violations(_commits(spark, sf_dir).select("sha", F.col("subject").alias("title")), ["sha"])


def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = spark.createDataFrame([("Ann", "ann@b.io")], "name string, email string")
    return C.coauthor_violations(_commits(spark, sf_dir), approved)


def prose_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all rules by source and category, in all documents."""
    return prose.prose_counts(table(spark, sf_dir, "documents"), ["source"])


#: A text without control characters that end lines elsewhere than in SQL.
_SHOWN = "regexp_replace(coalesce(text, ''), '[\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]', ' ', 'g')"


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as prose, as a fenced block, and as inline code that isn't closed."""
    text = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]", " "), "`~", "__")
    built = F.concat(F.lit("see `a b` and"), "text", F.lit("\n```py\n"), "text", F.lit("\n```\n"), "text", F.lit("`"), "text")
    # Each step is a column of its own: what an expression names several times would be computed as often.
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", built.alias("text"))
    return rows.select("doc_id", F.sha2(prose.mask_markdown_code(F.col("text")), 256).alias("digest"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.account_mismatch(_commits(spark, sf_dir), view(spark, sf_dir, "accounts"))


def unpushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir)
    return C.unpushed_commits(rows, rows.filter("seq % 13 <> 0")).select("repo", "sha", "seq")


def _denylist(fault: Column) -> Column:
    """The rules' list, with a fault by a number."""
    extra = F.when(fault == 1, "\nUtilize").when(fault == 2, "\n[nowhere]").otherwise("\n" + "other words")
    return F.concat(F.when(fault == 3, "loose\n").otherwise(""), F.lit(prose.DENYLIST), extra)


def denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of one region, as its SQL has it; s7_load_denylists reads lists with every fault."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    lines = explode_lines(regions.filter("r_regionkey = 1").select("r_regionkey", _denylist(F.col("r_regionkey")).alias("text")), ["r_regionkey"])
    return prose.load_denylist(lines)


def denylists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deny list for each supplier, with a fault by its key."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _denylist(F.col("s_suppkey") % 5).alias("text"))
    return prose.load_denylist(explode_lines(rows, ["s_suppkey"]), ["s_suppkey"])


def prose_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text, whatever its language."""
    return prose.prose_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def denied_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences in all documents of a deny list that is a table: the words of five plain letters and more of the benchmark's items."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    deny = table(spark, sf_dir, "benchmark").select("item_id", words.alias("entry")).groupBy("entry").agg(F.min("item_id").cast("int").alias("line"))
    rows = prose.prose_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], deny.withColumn("scope", F.lit("global")), rules=False)
    return rows.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id", F.col("s.detail").alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def message_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.message_prose(_commits(spark, sf_dir))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgate.functions.ship import ship

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sanitize_ascii(200)(F.col("text")).alias("shown"))


_WHO = "(SELECT repo, sha, 'author' AS role, author_name AS name, author_email AS email, author_login AS login, seq FROM commits UNION ALL SELECT repo, sha, 'committer', committer_name, committer_email, committer_login, seq FROM commits)"
_SIZE = "strlen(subject || chr(10) || chr(10) || body)"
_ENTRIES = ", ".join(f"('{entry}', '{scope}', {line})" for entry, scope, line in prose.default_denylist())
_LAST = "list_extract(string_split(regexp_replace(branch, '^[^/]*/', ''), '-'), -1)"
QUERIES = {
    "g1_subject_violations": (
        lambda spark, sf_dir: C.subject_violations(_commits(spark, sf_dir)),
        with_views(
            _subject_sql("subject must start with ''type: description''", "subject exceeds 50 characters", "subject ends with a period", "repo, sha", "(SELECT * FROM commits WHERE NOT is_merge)"),
            "commits",
        ),
    ),
    "g2_title_violations": (
        titles,
        with_views(_subject_sql("title format must use ''type: description''", "title exceeds 50 characters", "title ends with a period", "sha", "commits"), "commits"),
    ),
    "g3_terminal_trailers": (
        lambda spark, sf_dir: C.terminal_trailers(_commits(spark, sf_dir)),
        with_views(f"SELECT repo, sha, n, key, value FROM {_TRAILERS}", "commits"),
    ),
    "g4_coauthor_violations": (
        coauthors,
        with_views(
            f"""SELECT repo, sha, CASE WHEN seq % 8 = 6 THEN 'malformed co-author trailer' WHEN seq % 8 = 2 THEN 'unapproved co-author trailer for ''Bob''' ELSE 'unapproved co-author trailer for ''xAI''' END AS violation
            FROM {_TRAILERS} WHERE seq % 8 IN (2, 4, 6)""",
            "commits",
        ),
    ),
    "g5_banned_authors": (
        lambda spark, sf_dir: C.banned_authors(_commits(spark, sf_dir)),
        with_views(
            f"SELECT repo, sha, role, name, email FROM {_WHO} WHERE {_DENIED} UNION ALL SELECT repo, sha, 'co-author', 'xAI', 'dev@x.ai' FROM {_TRAILERS} WHERE seq % 8 = 4",
            "commits",
        ),
    ),
    "g6_identity_violations": (
        lambda spark, sf_dir: C.identity_violations(_commits(spark, sf_dir)),
        with_views(
            f"""SELECT repo, sha, 'user.email is unset' AS violation FROM commits WHERE author_email = '' UNION ALL
            SELECT repo, sha, 'author email ''' || author_email || ''' is not an allowed address' FROM commits WHERE author_email <> '' AND NOT regexp_matches(author_email, '{_NOREPLY}') UNION ALL
            SELECT repo, sha, 'committer email ''' || committer_email || ''' is not an allowed address' FROM commits WHERE author_email <> '' AND committer_email <> 'noreply@github.com' AND NOT regexp_matches(committer_email, '{_NOREPLY}')""",
            "commits",
        ),
    ),
    "g7_account_mismatch": (
        accounts,
        with_views(
            f"""SELECT repo, sha, role, violation FROM (SELECT repo, sha, role, CASE WHEN a.login IS NULL THEN 'identity could not be resolved'
              WHEN seq % 8 = 0 AND NOT regexp_matches(email, '{_NUMBERED}') THEN 'email must use a numbered noreply address'
              WHEN regexp_matches(email, '{_NUMBERED}') AND lower(regexp_extract(email, '{_NUMBERED}', 2)) <> lower(a.login) THEN 'noreply login does not match the account'
              WHEN regexp_matches(email, '{_NUMBERED}') AND regexp_extract(email, '{_NUMBERED}', 1) <> CAST(a.id AS VARCHAR) THEN 'noreply account ID does not match the account' END AS violation
            FROM {_WHO} AS w LEFT JOIN accounts AS a ON w.login = a.login) WHERE violation IS NOT NULL""",
            "commits", "accounts",
        ),
    ),
    "g8_unpushed_commits": (unpushed, with_views("SELECT repo, sha, seq FROM commits WHERE seq % 13 = 0", "commits")),
    "g9_identity_candidates": (
        lambda spark, sf_dir: C.identity_candidates(_commits(spark, sf_dir)),
        with_views(
            f"""SELECT repo, CAST(place AS INT) AS place, name, email FROM (SELECT repo, name, email, row_number() OVER (PARTITION BY repo ORDER BY min(turn * 2 + who)) AS place FROM (
              SELECT repo, turn, 0 AS who, author_name AS name, author_email AS email FROM l UNION ALL SELECT repo, turn, 1, committer_name, committer_email FROM l)
              WHERE name <> '' AND regexp_matches(email, '{_NUMBERED}') GROUP BY repo, name, email) WHERE place <= 5""",
            "commits",
        ).replace("\nSELECT repo, CAST(place", ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC, sha) AS turn FROM commits) WHERE turn <= 50)\nSELECT repo, CAST(place", 1),
    ),
    "g10_range_limits": (
        lambda spark, sf_dir: C.range_limits(_commits(spark, sf_dir), ["repo"]),
        with_views(
            f"SELECT repo, commits, largest, total, commits > 200 OR largest > 262144 OR total > 4194304 AS rejected FROM (SELECT repo, count(*) AS commits, CAST(max({_SIZE}) AS BIGINT) AS largest, CAST(sum({_SIZE}) AS BIGINT) AS total FROM commits GROUP BY repo)",
            "commits",
        ),
    ),
    "g11_branch_violations": (
        lambda spark, sf_dir: C.branch_violations(view(spark, sf_dir, "branches")),
        with_views(
            f"""SELECT repo, branch, CASE WHEN starts_with(branch, 'claude/') THEN 'uses a prohibited agent prefix' WHEN branch = 'fix/para-ti' THEN 'contains a clearly non-English token'
              WHEN branch = 'test/damn-thing' THEN 'contains a prohibited token' WHEN branch = 'docs/a1b2c3d' THEN 'ends with an opaque mixed alphanumeric token' ELSE 'does not match <type>/<kebab-description>' END AS violation
            FROM branches WHERE branch NOT IN ('main', 'chore/use-sha256') AND NOT starts_with(branch, 'feat/')""",
            "branches",
        ),
    ),
    "s7_load_denylist": (
        denylist,
        "SELECT entry, scope, CAST(line AS INT) AS line, CASE WHEN line = 18 THEN 'duplicate denylist entry' END AS error FROM (VALUES ('worth noting', 'global', 2), ('worst', 'global', 3), "
        "('serious', 'global', 4), ('testament', 'global', 5), ('serves as', 'global', 6), ('stands as', 'global', 7), ('functions as', 'global', 8), ('utilize', 'global', 9), "
        "('this session', 'handoff-exempt', 12), ('a round', 'handoff-exempt', 13), ('could not carry', 'handoff-exempt', 14), ('denied outright', 'handoff-exempt', 15), ('Denied:', 'handoff-exempt', 16), "
        "('the user', 'handoff-exempt', 17), ('Utilize', 'handoff-exempt', 18)) AS t(entry, scope, line)",
    ),
    "s7_load_denylists": (
        denylists,
        f"""SELECT s_suppkey, entry, scope, CAST(line + CASE WHEN s_suppkey % 5 = 3 THEN 1 ELSE 0 END AS INT) AS line, CAST(NULL AS VARCHAR) AS error
          FROM supplier, (VALUES {_ENTRIES}) AS t(entry, scope, line)
        UNION ALL SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'Utilize' WHEN 2 THEN '[nowhere]' ELSE 'other words' END, CASE s_suppkey % 5 WHEN 2 THEN 'nowhere' ELSE 'handoff-exempt' END,
          CASE s_suppkey % 5 WHEN 3 THEN 19 ELSE 18 END, CASE s_suppkey % 5 WHEN 1 THEN 'duplicate denylist entry' WHEN 2 THEN 'unknown denylist scope' END FROM supplier
        UNION ALL SELECT s_suppkey, 'loose', NULL, 1, 'denylist entry lacks a scope' FROM supplier WHERE s_suppkey % 5 = 3""",
    ),
    "w1_w3_prose_findings": (prose_findings, None),
    "w1_denylist_table": (
        denied_words,
        """SELECT doc_id, 'denylist line ' || line AS detail, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) AS d
        JOIN (SELECT word, min(item_id) AS line FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM benchmark) GROUP BY word) AS b USING (word) GROUP BY ALL""",
    ),
    "w5_message_prose": (message_prose, None),
    "w2_prose_counts": (prose_counts, None),
    "w3_mask_markdown_code": (
        masked,
        f"""SELECT doc_id, sha256('see       and' || t || chr(10) || '     ' || chr(10) || regexp_replace(t, '[^\\n]', ' ', 'g') || chr(10) || '   ' || chr(10) || t || ' ' || regexp_replace(t, '[^\\n]', ' ', 'g')) AS digest
          FROM (SELECT doc_id, translate({_SHOWN}, '`~', '__') AS t FROM documents)""",
    ),
    "w8_sanitize_ascii": (
        sanitized,
        """SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || '...[truncated]' END AS shown FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c:
          CASE WHEN c BETWEEN ' ' AND '~' THEN c WHEN unicode(c) <= 255 THEN '\\x' || lpad(lower(to_hex(unicode(c))), 2, '0') ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '') AS t FROM documents)""",
    ),
}
