"""Puts this package on the executors, so that their Python workers can import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send a copy of the package to the executors of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    # executors may fetch the archive at any time until the driver ends
    folder = tempfile.mkdtemp(prefix="chronofold-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder, "tree", package.name)
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, f"{package.name}-package")), "zip", copy.parent))
    _shipped.add(context.applicationId)
