"""Session defaults shared by the tests, the bench and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "encore", cores: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session; master, partitions and broadcast threshold are the cluster's unless a number of local cores is asked for."""
    builder = SparkSession.builder
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.sql.autoBroadcastJoinThreshold", "64m")
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ENCORE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a folder of this
    machine; any other master without it is an error, since each executor would
    write to its own disk. All folders of an application lie in one, which the
    file system removes when the application ends; results may be read until then.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    own = f"{base.rstrip('/')}/encore-{context.applicationId}"
    if getattr(context, "_encore_folder", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._encore_folder = own
    return f"{own}/scratch-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark application.

    Python functions are pickled by reference, so workers must be able to import
    ``encore`` wherever the driver was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_encore_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="encore-zip-"), "encore.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(target)
    context._encore_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder.

    A lost executor re-reads the table instead of repeating the plan that made
    it, and the planner knows its size.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
