"""Commit, branch and identity rules. `commits` has repo, sha, author_name, author_email, committer_name, committer_email,
subject, body, seq (rising) and is_merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.text import LINE_END
from corpusgate.operators.ranges import discard, written

#: Subjects, addresses, names and limits.
TYPES = ["feat", "fix", "chore", "docs", "test", "ci"]
SUBJECT = "^(?:feat|fix|chore|docs|test|ci): \\S.*$"
MAX_SUBJECT = 50
NOREPLY = "(?i)^(?:[0-9]+\\+)?[A-Za-z0-9-]+(?:\\[bot\\])?@users\\.noreply\\.github\\.com$"
NUMBERED = "(?i)^([0-9]+)\\+([A-Za-z0-9-]+)@users\\.noreply\\.github\\.com$"
PLATFORM_COMMITTER = "noreply@github.com"
TRAILER = "^([A-Za-z0-9-]+):"
PARAGRAPH = "^[A-Za-z0-9-]+:[^\\n]*(?:\\n(?:[ \\t]|[A-Za-z0-9-]+:)[^\\n]*)*$"
COAUTHOR = "^([^<>]+?)\\s*(?:<([^<>]+)>)?$"
DENIED_NAMES = ["grok", "xai"]
DENIED_DOMAINS = ["x.ai"]
MAX_COMMITS = 200
MAX_MESSAGE_BYTES = 256 * 1024
MAX_TOTAL_BYTES = 4 * 1024 * 1024
EXEMPT_BRANCHES = ["", "main", "master", "HEAD"]
AGENT_PREFIX = "claude/"
BANNED_TOKENS = [
    "ass", "bastard", "bitch", "crap", "damn", "dick", "fuck", "piss", "porn", "sex", "shit", "slut", "whore",
]
FOREIGN_TOKENS = [
    "el", "la", "de", "que", "una", "para", "con", "las", "los", "por", "como", "pero", "esta", "este", "cuando", "le", "des", "une", "est",
    "dans", "avec", "pas", "pour", "sont", "vous", "nous", "cette", "mais", "der", "die", "das", "und", "ist", "nicht", "auch", "eine",
    "einen", "sich", "auf", "nao", "dos", "com", "sao", "isso", "il", "di", "che", "sono", "questo", "anche", "sul",
]
TECHNICAL_TOKENS = [
    "base64", "es2022", "oauth2", "python310", "sha256",
]


def _when_list(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs]))


def _subject_rules(subject: Column, malformed: str, long: str, period: str) -> Column:
    """A malformed subject has that problem alone."""
    bare = F.regexp_replace(subject, " \\(#[0-9]+\\)$", "")
    fine = bare.rlike(SUBJECT)
    return F.when(~fine, F.array(F.lit(malformed))).otherwise(_when_list((F.char_length(bare) > MAX_SUBJECT, long), (bare.endswith("."), period)))


def subject_violations(commits: DataFrame) -> DataFrame:
    """repo, sha, violation; merges are passed over."""
    rules = _subject_rules(
        F.col("subject"), "subject must start with 'type: description'", f"subject exceeds {MAX_SUBJECT} characters", "subject ends with a period"
    )
    return commits.filter("not is_merge").select("repo", "sha", F.explode(rules).alias("violation"))


def title_violations(prs: DataFrame, key: list[str]) -> DataFrame:
    rules = _subject_rules(
        F.col("title"), "title format must use 'type: description'", f"title exceeds {MAX_SUBJECT} characters", "title ends with a period"
    )
    return prs.select(*key, F.explode(rules).alias("violation"))


def trailers_of(body: Column) -> Column:
    """array<struct<key, value>>: the trailers of a message.

    The last paragraph counts only if each of its lines is ``Key: value`` or, after one, a folded line."""
    # Line ends other than line feeds are rare, and become such.
    plain = F.when(body.rlike("[\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"), F.regexp_replace(body, LINE_END, "\n")).otherwise(body)
    paragraph = F.regexp_replace(F.element_at(F.split(F.regexp_replace(plain, "(?U)\\s+$", ""), "(?U)\\n\\s*\\n", -1), -1), "^\n+", "")
    entries = F.when(paragraph.rlike(PARAGRAPH), F.split(paragraph, "\\n(?![ \\t])", -1)).otherwise(F.array().cast("array<string>"))
    folded = lambda v: F.regexp_replace(v, "(?U)\\n\\s+", "\n")
    return F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, TRAILER, 1).alias("key"), folded(F.regexp_replace(e, "^[A-Za-z0-9-]+:[ \\t]*", "")).alias("value")
        ),
    )


def terminal_trailers(commits: DataFrame) -> DataFrame:
    """repo, sha, n, key, value of each trailer."""
    rows = commits.select("repo", "sha", F.posexplode(trailers_of(F.col("body"))).alias("n", "t"))
    return rows.select("repo", "sha", "n", "t.key", "t.value")


def coauthors(commits: DataFrame) -> DataFrame:
    """repo, sha, n, name, email (null without one), malformed of each co-author trailer."""
    rows = terminal_trailers(commits).filter(F.lower("key") == "co-authored-by")
    value = F.regexp_replace("value", "(?U)^\\s+|\\s+$", "")
    rows = rows.withColumn("value", value).withColumn("malformed", ~value.rlike(COAUTHOR))
    name = F.trim(F.regexp_extract("value", COAUTHOR, 1))
    email = F.nullif(F.regexp_extract("value", COAUTHOR, 2), F.lit(""))
    return rows.select("repo", "sha", "n", name.alias("name"), email.alias("email"), "malformed")


def coauthor_violations(commits: DataFrame, approved: DataFrame) -> DataFrame:
    """repo, sha, violation. A name alone is a label and passes; approved has name, email."""
    rows = coauthors(commits)
    bad = rows.filter("malformed").select("repo", "sha", F.lit("malformed co-author trailer").alias("violation"))
    named = rows.filter("not malformed and email is not null").join(approved, ["name", "email"], "left_anti")
    message = F.concat(F.lit("unapproved co-author trailer for '"), "name", F.lit("'"))
    return bad.unionByName(named.select("repo", "sha", message.alias("violation")))


def is_denied(name: Column, email: Column) -> Column:
    """A denied term in the name or the address's local part, or a denied domain. The terms are few: one pattern each."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    address = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    terms = "|".join(DENIED_NAMES)
    domains = "(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in DENIED_DOMAINS) + ")$"
    domain = F.when(address.contains("@"), F.element_at(F.split(address, "@"), -1)).otherwise("")
    local = F.element_at(F.split(address, "@"), 1)
    return bare(name).rlike(terms) | bare(local).rlike(terms) | domain.rlike(domains)


def banned_authors(commits: DataFrame) -> DataFrame:
    """repo, sha, role, name, email of authors, committers and co-authors that are denied."""
    who = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_name").alias("name"), F.col(f"{role}_email").alias("email"))
    own = commits.select("repo", "sha", F.explode(F.array(who("author"), who("committer"))).alias("p")).select("repo", "sha", "p.*")
    others = coauthors(commits).filter("not malformed").select("repo", "sha", F.lit("co-author").alias("role"), "name", F.coalesce("email", F.lit("")).alias("email"))
    return own.unionByName(others).filter(is_denied(F.col("name"), F.col("email")))


def identity_violations(commits: DataFrame) -> DataFrame:
    """repo, sha, violation of addresses that aren't the platform's noreply ones; unset fields are told alone."""
    unset = _when_list(
        (F.trim(F.coalesce("author_email", F.lit(""))) == "", "user.email is unset"), (F.trim(F.coalesce("author_name", F.lit(""))) == "", "user.name is unset")
    )
    fine = lambda c: F.trim(c).rlike(NOREPLY)
    platform = F.lower(F.trim("committer_email")) == PLATFORM_COMMITTER
    told = lambda role: F.concat(F.lit(f"{role} email '"), f"{role}_email", F.lit("' is not an allowed address"))
    wrong = _when_list((~fine("author_email"), told("author")), (~platform & ~fine("committer_email"), told("committer")))
    return commits.select("repo", "sha", F.explode(F.when(F.size(unset) > 0, unset).otherwise(wrong)).alias("violation"))


def account_mismatch(commits: DataFrame, accounts: DataFrame) -> DataFrame:
    """repo, sha, role, violation. commits has author_login and committer_login, accounts has login and id.

    Commits with a label (a co-author without an address) need numbered addresses."""
    labels = coauthors(commits).filter("not malformed and email is null").select("repo", "sha").distinct().withColumn("labelled", F.lit(True))
    who = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_email").alias("email"), F.col(f"{role}_login").alias("login"))
    rows = commits.select("repo", "sha", F.explode(F.array(who("author"), who("committer"))).alias("p")).select("repo", "sha", "p.*")
    known = accounts.select(F.col("login").alias("known"), "id")
    rows = rows.join(known, rows["login"] == known["known"], "left").join(labels, ["repo", "sha"], "left")
    number, login = F.regexp_extract("email", NUMBERED, 1), F.regexp_extract("email", NUMBERED, 2)
    numbered = F.col("email").rlike(NUMBERED)
    violation = (
        F.when(F.col("known").isNull(), "identity could not be resolved")
        .when(F.coalesce("labelled", F.lit(False)) & ~numbered, "email must use a numbered noreply address")
        .when(numbered & (F.lower(login) != F.lower("known")), "noreply login does not match the account")
        .when(numbered & (number != F.col("id").cast("string")), "noreply account ID does not match the account")
    )
    return rows.select("repo", "sha", "role", violation.alias("violation")).filter("violation is not null")


def unpushed_commits(head: DataFrame, remote: DataFrame) -> DataFrame:
    return head.join(remote.select("repo", "sha"), ["repo", "sha"], "left_anti")


def unreachable_commits(history: DataFrame, heads: DataFrame, remotes: DataFrame) -> DataFrame:
    """repo, sha of the commits that a head reaches over parents and no remote ref does.

    history: repo, sha, parents (array), generation (greater than that of every parent). heads and remotes: repo, sha; refs to commits that aren't in
    the history reach nothing. Both sides go down in step, a generation's width at a time: each round follows the parents of what the last one
    reached. Remote refs are followed only as long as something below them may still be in question, so rounds are bounded by how far heads and
    refs have parted, not by the length of the history. A round reads what the last one wrote, and the edges."""
    edges = written(history.select("repo", "sha", F.explode("parents").alias("parent")).join(history.select("repo", F.col("sha").alias("parent"), F.col("generation").alias("low")), ["repo", "parent"]), "edges")
    known = history.select("repo", "sha", "generation")
    refs = heads.select("repo", "sha", F.lit(False).alias("remote")).unionByName(remotes.select("repo", "sha", F.lit(True).alias("remote")))
    reached = written(known.join(refs.groupBy("repo", "sha").agg(F.bool_or("remote").alias("remote")), ["repo", "sha"]).withColumn("fresh", F.lit(True)), "reached")
    while True:
        # What is in question in each repository: commits that only heads reach so far. Below the lowest of them, and of what they lead to, nothing matters.
        open_ends = reached.filter("not remote").groupBy("repo").agg(F.min("generation").alias("lowest"), F.bool_or("fresh").alias("going"))
        fresh = reached.filter("fresh").join(open_ends, "repo").filter("not remote or going or generation > lowest")
        step = fresh.select("repo", "sha", "remote").join(edges, ["repo", "sha"]).select("repo", F.col("parent").alias("sha"), F.col("low").alias("generation"), "remote")
        both = reached.withColumn("old", F.lit(True)).unionByName(step.withColumn("fresh", F.lit(True)).withColumn("old", F.lit(False)))
        merged = both.groupBy("repo", "sha").agg(
            F.max("generation").alias("generation"),
            F.bool_or("remote").alias("remote"),
            # A commit goes on if it is new, or if a remote ref comes to one that only heads had reached.
            (~F.bool_or("old") | (F.bool_or("remote") & ~F.bool_or(F.col("remote") & F.col("old")))).alias("fresh"),
        )
        last, reached = reached, written(merged, "reached")
        discard(last)
        if reached.filter("fresh").isEmpty():
            return reached.filter("not remote").select("repo", "sha")


def identity_candidates(commits: DataFrame, k: int = 5, last: int = 50) -> DataFrame:
    """repo, place, name, email: the first k distinct numbered identities among each repository's latest commits."""
    latest = commits.withColumn("turn", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("seq").desc(), "sha"))).filter(F.col("turn") <= last)
    who = lambda i, role: F.struct((F.col("turn") * 2 + i).alias("place"), F.trim(f"{role}_name").alias("name"), F.trim(f"{role}_email").alias("email"))
    rows = latest.select("repo", F.explode(F.array(who(0, "author"), who(1, "committer"))).alias("p")).select("repo", "p.*")
    rows = rows.filter((F.col("name") != "") & F.col("email").rlike(NUMBERED)).groupBy("repo", "name", "email").agg(F.min("place").alias("first"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("first"))
    return rows.select("repo", place.alias("place"), "name", "email").filter(F.col("place") <= k)


def range_limits(commits: DataFrame, key: list[str]) -> DataFrame:
    """key, commits, largest, total, rejected: whether a range is beyond what is checked."""
    size = F.octet_length(F.concat_ws("\n\n", "subject", "body"))
    by = commits.groupBy(*key).agg(F.count(F.lit(1)).alias("commits"), F.max(size).cast("bigint").alias("largest"), F.sum(size).alias("total"))
    over = (F.col("commits") > MAX_COMMITS) | (F.col("largest") > MAX_MESSAGE_BYTES) | (F.col("total") > MAX_TOTAL_BYTES)
    return by.withColumn("rejected", over)


def branch_rules(branch: Column, strict: bool = False) -> Column:
    """Array of what is wrong with a branch's name."""
    lower = F.lower(branch)
    tokens = F.split(F.substr(branch, F.greatest(F.instr(branch, "/"), F.lit(0)) + 1), "-")
    last = F.element_at(tokens, -1)
    isin = lambda words: lambda t: F.lower(t).isin(words)
    banned = F.transform(F.filter(tokens, isin(BANNED_TOKENS)), lambda t: F.lit("contains a prohibited token"))
    foreign = F.transform(F.filter(tokens, isin(FOREIGN_TOKENS)), lambda t: F.lit("contains a clearly non-English token"))
    opaque = ~F.lower(last).isin(TECHNICAL_TOKENS) & F.char_length(last).between(6, 12) & last.rlike("[a-z]") & last.rlike("[0-9]")
    shape = branch.rlike("^(?:" + "|".join(TYPES) + ")/[a-z0-9]+(?:-[a-z0-9]+)*$")
    exempt = F.lit(False) if strict else branch.isin(EXEMPT_BRANCHES)
    return (
        F.when(lower.startswith(AGENT_PREFIX), F.array(F.lit("uses a prohibited agent prefix")))
        .when(exempt, F.array().cast("array<string>"))
        .when(shape, F.concat(banned, foreign, _when_list((opaque, "ends with an opaque mixed alphanumeric token"))))
        .otherwise(F.array(F.lit("does not match <type>/<kebab-description>")))
    )


def branch_violations(branches: DataFrame, strict: bool = False) -> DataFrame:
    """repo, branch, violation."""
    return branches.select("repo", "branch", F.explode(branch_rules(F.col("branch"), strict)).alias("violation"))
