"""The session: its settings, and the package's own code on every Python worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for stored results. Where none is set, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pagewright.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.pagewright.checkpoint.dir", root)
    return root.rstrip("/")


def with_code(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once for each application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        handle, name = tempfile.mkstemp(prefix="pagewright-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(ROOT.rglob("*.py")):
                archive.write(path, path.relative_to(ROOT.parent))
        spark.sparkContext.addPyFile(name)
        _sent.add(app)
    return spark
