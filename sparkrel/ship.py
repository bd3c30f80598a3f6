"""The package, sent to a session's workers, for clusters where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session's Python files, once; Spark serves them to its executors."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_sparkrel_shipped", False) or not root.is_dir():
        return
    at = Path(tempfile.mkdtemp(prefix="sparkrel-")) / "sparkrel.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(at))
    context._sparkrel_shipped = True
