"""Column functions on text and paths: lines, positions, path facts, cleaning. All built-in expressions but `sanitize_ascii`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.arrays import running_total

#: Where a line ends, as in Python's splitlines.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
#: Suffixes and names that tell what a file is.
PYTHON = [".py"]
JS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
SOURCE = PYTHON + JS + [".go", ".rs", ".java", ".kt", ".rb", ".php", ".cs", ".c", ".cc", ".cpp", ".h", ".hpp", ".swift", ".scala", ".sh"]
CONFIG = [".yml", ".yaml", ".toml", ".cfg", ".ini"]
MARKDOWN = [".md", ".markdown", ".mdown", ".mkdn", ".mdx"]
TEST_FOLDERS = ["tests", "test", "__tests__", "spec"]
SKIPPED_FOLDERS = [".git", "node_modules", ".venv", "venv", "__pycache__", "vendor", "dist", "build", ".tox", ".mypy_cache"]
DOCUMENTATION_HOSTS = "(^|\\.)(example\\.(com|org|net)|localhost)$|\\.(example|test|invalid)$"


def splitlines(text: Column) -> Column:
    """The lines of a text; a last line end opens no line, and an empty text has none."""
    parts = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def explode_lines(files: DataFrame, keep: list[str], hit: str | None = None, text: str = "text") -> DataFrame:
    """A row for each line: the columns in keep, line (from 1) and line_text.

    hit: a pattern that a line must find. Texts without it (anywhere, if it is one for a line's start) aren't exploded,
    and only lines with it come out."""
    rows = files.filter(F.col(text).rlike(hit.removeprefix("^"))) if hit else files
    lines = rows.select(*keep, F.posexplode(splitlines(F.col(text))).alias("line", "line_text"))
    lines = lines.withColumn("line", F.col("line") + 1)
    return lines.filter(F.col("line_text").rlike(hit)) if hit else lines


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix of the name, with its dot, as pathlib has it: none for a leading or a last dot."""
    return F.regexp_extract(file_name(path), "^.+(\\.[^.]+)$", 1)


def is_test_path(path: Column) -> Column:
    """In a test folder, or named like a test."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return (
        F.arrays_overlap(folders, F.array(*[F.lit(x) for x in TEST_FOLDERS]))
        | name.startswith("test_")
        | F.element_at(F.split(name, "\\."), 1).endswith("_test")
        | name.contains(".spec.")
        | name.contains(".test.")
    )


def path_facts(files: DataFrame) -> DataFrame:
    """files with suffix, is_test, is_source, is_config, is_js, is_markdown."""
    return files.withColumn("suffix", suffix(F.col("path"))).select(
        "*",
        is_test_path(F.col("path")).alias("is_test"),
        F.col("suffix").isin(SOURCE).alias("is_source"),
        F.col("suffix").isin(CONFIG).alias("is_config"),
        F.col("suffix").isin(JS).alias("is_js"),
        F.lower("suffix").isin(MARKDOWN).alias("is_markdown"),
    )


def in_skipped_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))


def is_documentation_host(host: Column) -> Column:
    """Reserved documentation names, their sub-domains, and localhost."""
    return F.lower(host).rlike(DOCUMENTATION_HOSTS)


def match_starts(text: Column, pattern: str) -> Column:
    """Array of 0-based places (code points) where the pattern's matches begin, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: (F.char_length(g) + F.char_length(m)).cast("bigint"))
    starts = F.zip_with(found, running_total(steps), lambda m, stop: (stop - F.char_length(m)).cast("int"))
    return F.when(text.rlike(pattern), starts).otherwise(F.array().cast("array<int>"))


def line_of(text: Column, start: Column) -> Column:
    """The line, from 1, of a place in a text; only line feeds count."""
    head = F.substring(text, F.lit(1), start)
    return F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """The distance of a place from the line feed before it: 1 for a line's first character."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def redact_credentials(text: Column) -> Column:
    """token, password, secret or authorization, then : or =: the value goes."""
    return F.regexp_replace(text, "(?i)(token|password|secret|authorization)(\\s*[:=]\\s*)\\S+", "$1$2<redacted>")


def clean_control(text: Column) -> Column:
    """C0 controls but tab, line feed and carriage return, and DEL, become ?; then credentials go."""
    return redact_credentials(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "?"))


def sanitize_ascii(limit: int = 500):
    """A function of a column: printable ASCII stays, the rest is escaped, and what exceeds the limit is cut off."""

    def escaped(c: str) -> str:
        return c if " " <= c <= "~" else f"\\x{ord(c):02x}" if ord(c) <= 0xFF else f"\\u{ord(c):04x}"

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        out = value if value.isascii() and value.isprintable() else "".join(map(escaped, value))
        return out if len(out) <= limit else out[:limit] + "...[truncated]"

    @F.pandas_udf("string")
    def sanitized(values: pd.Series) -> pd.Series:
        return values.map(one)

    return sanitized


def has_literal_escape(text: Column) -> Column:
    """A backslash and an n, where a line feed was meant."""
    return text.contains("\\n")


def escaped_size(text: Column) -> Column:
    """UTF-8 bytes of the text as a JSON string, without the quotes."""
    return F.octet_length(F.to_json(F.struct(text.alias("x")))) - F.lit(len('{"x":""}'))


