"""Sends this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's application, once."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "sonamark_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, os.path.join(PACKAGE.name, p.relative_to(PACKAGE)))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
