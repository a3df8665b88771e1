"""Send this package to the Python workers, which need not see the driver's folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files for Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        here = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="sievewright-")  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / f"{here.name}_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"{here.name}/{p.relative_to(here)}")
        sc.addPyFile(str(archive))
        _sent.add(sc.applicationId)
    return spark
