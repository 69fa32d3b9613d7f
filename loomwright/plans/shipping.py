"""Ships the package to the Python workers, as --py-files would."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files once, so workers can import it wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_loomwright_shipped", False):
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="loomwright-"))
        shutil.copytree(root, out / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(out / root.name), "zip", out / "code"))
        sc._loomwright_shipped = True
