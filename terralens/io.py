"""Reading the engine's tables and keeping intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need no path to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="terralens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "terralens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; columns are pruned by the caller's select."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate results: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests, a laptop) is a local folder chosen; a cluster without a
    shared folder is an error, for its executors would each write to a folder of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "terralens-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage with a reliable checkpoint in the shared folder; it outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` was counted to hold at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows. Beyond the bound the DataFrame comes back unhinted and
    the join shuffles (AQE splits its skewed partitions).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
