"""Making the package importable by the Python workers of any cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application; workers then import it by name."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="quire-")
        try:
            target = Path(folder, "package", "quire")
            shutil.copytree(root / "quire", target, ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(os.path.join(folder, f"quire-{os.getpid()}"), "zip", target.parent)
            sc.addPyFile(archive)
        finally:
            shutil.rmtree(Path(folder, "package"), ignore_errors=True)
        _shipped.add(sc.applicationId)
    return spark
