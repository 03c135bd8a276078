"""Sessions, and this package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(name: str = "pageloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries expect; on a cluster, pass an own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that kernels can be imported there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="pageloom-code-"), "pageloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    return spark
