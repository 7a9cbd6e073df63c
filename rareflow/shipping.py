"""Send this package to Python workers that cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; nothing to do where PYTHONPATH already names the repository."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _SENT:
        return
    archive = Path(tempfile.mkdtemp(prefix="rareflow-")) / "rareflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "rareflow").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _SENT.add(sc.applicationId)
