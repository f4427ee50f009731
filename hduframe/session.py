"""What a session needs before the package's Python code runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="hduframe-ship-")
        with zipfile.ZipFile(os.path.join(folder, "hduframe_src.zip"), "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(os.path.join(folder, "hduframe_src.zip"))
        _SHIPPED.add(app)
    return spark
