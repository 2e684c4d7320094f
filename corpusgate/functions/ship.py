"""Sends this package to the executors, so that functions mapped over batches can import it there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zipped Python file, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
