"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications whose executors have this code already.
_shared: set[str] = set()


def share_code(spark: SparkSession, root: str) -> None:
    """Sends the packages and modules of ``root`` that queries use to the executors, once an application.

    Workers unpickle functions by their module's name; they need it wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shared:
        return
    _shared.add(app)
    archive = Path(tempfile.mkdtemp(prefix="forgeframe-code-")) / "forgeframe_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in [*sorted(Path(root, "forgeframe").rglob("*.py")), *Path(root).glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def session(master: str | None = None, name: str = "forgeframe", partitions: int | None = None) -> SparkSession:
    """Adaptive plans, UTC, ANSI arithmetic; ``partitions`` only for small local runs, else the cluster decides."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.master(master) if master else b
    return (b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b).getOrCreate()
