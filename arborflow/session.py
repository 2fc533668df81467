"""Sessions: makes this package known to the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="arborflow-")
        path = os.path.join(folder, "arborflow.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shipped(query):
    """A query (spark, sf_dir) that ships the package first."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run
