"""The package itself for Python workers on other machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the application's workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    here = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="framespark-ship-")) / "framespark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("framespark") / p.relative_to(here)))
    context.addPyFile(str(target))
