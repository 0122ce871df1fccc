"""Making this package importable for the Python workers of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's sources to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="genoloom-")) / "genoloom-sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "genoloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
