"""What a cluster shares: this package's modules in Python workers, and the folder that driver and executors see."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each application."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="veridoc-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(name)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder, or, where neither is set (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_to.get() if set_to.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veridoc-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
