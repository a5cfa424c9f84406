"""Making this package known to Python workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once per application.

    Not needed where they find it: on PYTHONPATH, installed, or in the working folder of a local master.
    """
    context = spark.sparkContext
    places = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if context.master.startswith("local["):
        places.add(os.path.realpath("."))
    if str(ROOT.parent) in places or ROOT.parent.name in ("site-packages", "dist-packages") or context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="postalloom-"), "postalloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
