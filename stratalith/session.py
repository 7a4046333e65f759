"""Session helper and the settings every operator relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "stratalith", **conf: str) -> SparkSession:
    """The running session, or a new local one with the engine's defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in conf and not os.environ.get("MASTER"):
        builder = builder.master("local[*]")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset and all executors are on this machine (tests, a laptop), a private folder is made, which goes
    with the process; on a cluster that is an error, since executors don't share a machine's own folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="stratalith-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the copy survives the loss of executors.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set by :func:`get_session`) deletes copies that nothing refers to any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per application."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_stratalith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stratalith-")) / "stratalith.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._stratalith_shipped = True


def spread(df: DataFrame, least_bytes: int = 1 << 19) -> DataFrame:
    """``df`` over all cores, if it is a scan of fewer partitions than there are cores (one small file, say).

    A scan that fills the cores, as any large one does, is left as it is, without a shuffle; so is a plan
    that already has one. No partition is made for under ``least_bytes`` of input.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, int(str(execution.optimizedPlan().stats().sizeInBytes())) // least_bytes)
    return df.repartition(wanted) if execution.toRdd().getNumPartitions() < wanted else df
