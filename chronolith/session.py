"""A session with the settings that the library's results rely on: UTC, adaptive plans."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "chronolith", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where the path already leads there, else a zip, once a context."""
    root = Path(__file__).resolve().parent.parent
    paths = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."] if p}
    context = spark.sparkContext
    if root in paths or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="chronolith-")
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/chronolith.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(f"{folder}/chronolith.zip")
    _shipped.add(context.applicationId)
