"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession | None = None) -> None:
    """Adds the package's source to the session's files, once, unless workers find it by PYTHONPATH or in the working folder anyway. Spark sends it to every executor."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or Path.cwd() == ROOT or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_causeway_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "causeway.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "causeway").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    context._causeway_shipped = True
