"""What work on a cluster needs: the package on the executors, and folders that all of them see."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, as in tests, a local one, if everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _folders:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that {master} shares")
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return _folders[app]
