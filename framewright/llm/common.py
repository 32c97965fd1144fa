"""Session handling shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from framewright.session import read_table

__all__ = ["checkpointed", "read_table", "shared_folder", "tidy"]

#: Seconds between two collections of the driver's garbage at least.
TIDY_S = 4.0
_tidied = [0.0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's checkpoint folder is used as it is; one is set only where none is (local tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, for tables that outlive one job."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def tidy(spark: SparkSession, every: float | None = None) -> None:
    """Has the driver collect its garbage, at most once in ``every`` seconds (``TIDY_S``). Spark drops a step's shuffle files and broadcasts only
    once the driver has collected the step's plan, which a driver with room to spare may never do."""
    if time.monotonic() - _tidied[0] >= (TIDY_S if every is None else every):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so a lost executor costs no recomputation; what the
    steps before have left goes first."""
    ensure_checkpoint_dir(df.sparkSession)
    tidy(df.sparkSession)
    return df.checkpoint(eager=True)
