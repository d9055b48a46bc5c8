"""The library on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import noticeloom

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's sources to the executors of this session's cluster, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(noticeloom.__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="noticeloom-"), "noticeloom.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(name)
    _SENT.add(context.applicationId)
