"""Python workers need this package; wherever they can't import it already, it goes along as a file of the application."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package, on any cluster, once for each application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parents[2]
    if app in _shipped:
        return
    _shipped.add(app)
    if str(root) in (os.environ.get("PYTHONPATH") or "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()
    name = f"{folder}/kindred_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "kindred").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    atexit.register(shutil.rmtree, folder, True)
