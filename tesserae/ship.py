"""Makes this package importable by Spark's Python workers, wherever they run."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


@functools.cache
def archive() -> str:
    path = Path(tempfile.mkdtemp(prefix="tesserae-ship-"), "tesserae.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted([*HERE.rglob("*.py"), *HERE.rglob("*.txt")]):
            z.write(p, p.relative_to(HERE.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Send the package to the session's executors, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_tesserae_shipped", False):
        sc.addPyFile(archive())
        sc._tesserae_shipped = True


def shipped(f):
    """f(spark, ...), after the package has been sent."""

    @functools.wraps(f)
    def call(spark, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return call
