"""Makes the package importable on executors whose Python path doesn't hold it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: sends the package's sources along with it, unless they run here and inherit a path that has them."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    # Only workers on this host see the driver's path and working folder.
    if context.master.startswith("local[") and (root in inherited or Path.cwd() == root):
        return
    target = Path(tempfile.mkdtemp(prefix="framelake-")) / "framelake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "framelake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
