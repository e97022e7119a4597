"""What a Spark application needs of this package: shared scratch space, code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, where the application has not said how many: a row may hold a whole text or two.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for their Python workers."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH[0]) and spark.conf.get(BATCH[0]) != BATCH[1]:
        spark.conf.set(*BATCH)
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="rivulet-ship-")) / "rivulet_src.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)


def ship_active() -> None:
    """As :func:`ship`, for columns, which do not know their session."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
