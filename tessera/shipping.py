"""Makes this package importable by Python workers, whichever machine they run on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def shipped(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._tessera_shipped = True
