"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch where a row holds a whole text and its words.
TEXT_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()
_own_rows: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="newsloom-code-")) / "newsloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def batch_rows(spark: SparkSession, most: int | None) -> None:
    """At most so many rows in the Arrow batches of the query to come; None is what the session had at first.

    A Python worker holds a batch and what it makes of it, and a stage has a worker for each of its passes through Python.
    """
    own = _own_rows.setdefault(spark.sparkContext.applicationId, spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(min(most, int(own)) if int(own) > 0 else most) if most else own)
