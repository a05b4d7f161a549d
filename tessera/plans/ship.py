"""Making this package importable on the workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a session; functions then go by name, and a worker keeps its caches."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", None) == str(PACKAGE) or not PACKAGE.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="tessera-")  # on the driver, which serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{PACKAGE.name}-sources.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._shipped_package = str(PACKAGE)
