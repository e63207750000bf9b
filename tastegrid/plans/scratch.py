"""Shared storage for intermediate tables, lineage cuts and size checks.

Everything written here goes below the folder named by ``spark.checkpoint.dir``,
which all executors share, so a lost executor never loses an intermediate.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWNED: list[str] = []
_SHIPPED: set[str] = set()


def _cleanup() -> None:
    for path in _OWNED:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_cleanup)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A temporary one is set only on a single machine where none is configured; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='tastegrid-')}"
        _OWNED.append(own)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tastegrid-{name}-{uuid.uuid4().hex}"
    if path.startswith(("/", "file:")):
        _OWNED.append("file://" + path.removeprefix("file://").removeprefix("file:"))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, **options: str) -> str:
    """Write ``df`` once as parquet in the shared folder and return the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package where their search path lacks it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    target = os.path.join(tempfile.mkdtemp(prefix="tastegrid-code-"), "tastegrid.zip")
    _OWNED.append(os.path.dirname(target))
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(os.path.join(here, "tastegrid")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, here))
    spark.sparkContext.addPyFile(target)


def collect_if_small(df: DataFrame, limit: int) -> list | None:
    """All rows of ``df`` if there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions configured for the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
