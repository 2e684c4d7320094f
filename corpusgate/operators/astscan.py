"""Syntax-tree scans: one pass over the files, one parse of each, every rule on that parse.

Files are spread by Spark; a task holds one file's tree at a time. A file that is no valid Python is passed over, one
that exhausts the parser is reported in `unparsed`, and neither fails a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusgate.functions import pyrules, regexrules
from corpusgate.functions.ship import ship
from corpusgate.functions.text import JS, PYTHON, suffix
from corpusgate.operators.findings import finding
from corpusgate.operators.textscan import TREE

_FINDINGS = "repo string, rev string, path string, line int, class_id string, message string, blocking boolean"
_ARROW = pa.schema(
    [("repo", pa.string()), ("rev", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("class_id", pa.string()), ("message", pa.string()), ("blocking", pa.bool_())]
)


def _python(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.filter(suffix(F.col("path")).isin(PYTHON)).select(*TREE, "path", "text")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str, str]]:
    """One row at a time, so a batch of large files isn't held twice."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in range(4))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for repo, rev, path, text in _rows(batch):
            index, failed = pyrules.parsed(text or "")
            if failed == "limit":
                out.append((repo, rev, path, 0, "", "unparsed", False))
            if index is not None:
                out += {(repo, rev, path, *row) for rule in pyrules.RULES for row in rule(index)}
        columns = list(zip(*out, strict=True)) or [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def scan_python(files: DataFrame) -> DataFrame:
    """Findings of all rules of `pyrules` over the Python files, and a row of class "" for each that exhausts the parser."""
    return _python(files).mapInArrow(_scanned, _FINDINGS)


def python_findings(files: DataFrame, classes: list[str] | None = None) -> DataFrame:
    rows = scan_python(files).filter("class_id <> ''")
    return rows.filter(F.col("class_id").isin(classes)) if classes else rows


def unparsed(files: DataFrame) -> DataFrame:
    """TREE, path of the files that exhaust the parser; they count as not reviewed."""
    return scan_python(files).filter("class_id = ''").select(*TREE, "path")


def _imported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for repo, rev, path, text in _rows(batch):
            index, _ = pyrules.parsed(text or "")
            out += [(repo, rev, path, name) for name in (pyrules.imports(index) if index else ())]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["repo", "rev", "path", "name"])


def python_imports(files: DataFrame) -> DataFrame:
    """TREE, path, name: the top-level modules that each Python file imports."""
    return _python(files).mapInArrow(_imported, "repo string, rev string, path string, name string")


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for repo, rev, path, text in _rows(batch):
            if path.endswith(".py"):
                index, _ = pyrules.parsed(text or "")
                found = pyrules.regex_literals(index) if index else ()
            else:
                found = regexrules.js_literals(text or "")
            out += [(repo, rev, path, line, pattern) for line, pattern in found]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        names = ["repo", "rev", "path", "line", "pattern"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def regex_literals(files: DataFrame) -> DataFrame:
    """TREE, path, line, pattern of the regular expressions in Python and JavaScript files."""
    ship(files.sparkSession)
    wanted = files.filter(suffix(F.col("path")).isin(PYTHON + JS)).select(*TREE, "path", "text")
    return wanted.mapInArrow(_literals, "repo string, rev string, path string, line int, pattern string")


@F.pandas_udf(StringType())
def _hazards(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else regexrules.hazard(p))


def regex_hazards(patterns: DataFrame) -> DataFrame:
    """patterns with hazard; each distinct pattern is read once."""
    ship(patterns.sparkSession)
    distinct = patterns.select("pattern").distinct().withColumn("hazard", _hazards("pattern"))
    return patterns.join(distinct, "pattern")


def regex_findings(files: DataFrame) -> DataFrame:
    rows = regex_hazards(regex_literals(files)).filter("hazard is not null")
    message = F.concat(F.lit("regex "), "hazard", F.lit(": "), "pattern")
    return rows.select(*TREE, "path", *finding("Q3", message, False))
