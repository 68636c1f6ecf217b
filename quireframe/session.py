"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions find it there even where it
    is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quireframe-code-")) / "quireframe_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))


def ship_to_active() -> None:
    """``ship_code`` for what makes columns and has no frame to tell its session by."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship_code(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names, so that its lineage ends there. Where
    a session names none, one is made if driver and executors are one process; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quireframe-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in the one that ``spark.checkpoint.dir`` names; where a session names none, one is made if
    driver and executors are one process, and on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quireframe-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/quireframe-{spark.sparkContext.applicationId}"
