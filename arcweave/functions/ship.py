"""Make this package importable on executors that do not already have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="arcweave-"), "arcweave_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "arcweave")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
        if os.path.exists(pipeline := os.path.join(root, "corpus_pipeline.py")):
            z.write(pipeline, "corpus_pipeline.py")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
