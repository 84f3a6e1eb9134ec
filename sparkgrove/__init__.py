"""Sparkgrove: feature-table analysis and classification as Spark jobs, with a
separate ``llm`` subpackage of training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors of a session, once, so that tasks can import
    it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkgrove-")) / "sparkgrove.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
