"""This package on the executors: their Python need not find it where the driver does."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for an application; functions made after that find it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="veritrace-code-"), f"{here.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
