"""Session builder shared by the tests, the bench and the command line."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chronoloom", cpus: int | None = None, memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A local session with the settings every query expects: UTC, AQE, Arrow, and as many shuffle partitions as cores."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | (extra or {})
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that the context was given; a temporary one only where both are unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: a temporary one is of one machine")
        found = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder: its lineage ends there, and it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application: functions are pickled by reference, and the
    executors' own path needn't have it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="chronoloom-")).resolve() / "chronoloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


#: Rows of an Arrow batch that goes to a Python worker, where the session has Spark's own default: texts and arrays are wide rows, and
#: a worker holds a batch as Arrow, as Python objects and as its result.
BATCH_ROWS = 2000


def shipping(run):
    """run(spark, ...) with the package shipped first, and Arrow batches that fit wide rows."""

    @functools.wraps(run)
    def shipped(spark, *args, **kwargs):
        ship(spark)
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return run(spark, *args, **kwargs)

    return shipped
