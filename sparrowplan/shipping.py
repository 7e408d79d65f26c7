"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="sparrowplan-code-"), "sparrowplan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted([*ROOT.glob("sparrowplan/**/*.py"), *ROOT.glob("*.py")]):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
