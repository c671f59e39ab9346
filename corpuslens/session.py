"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a cheap side, such as a query set, up to which it is broadcast.
FEW_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose nodes don't share that path, install the package or pass it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """Hint a broadcast if ``df``, which must be cheap to count, has at most so many rows; else leave it to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, uniquely named folder under the one that the driver and all executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuslens-shared-")
        warnings.warn(f"spark.checkpoint.dir isn't set; intermediate tables of this machine go to {found}", stacklevel=2)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder; only a session on one machine may have named none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuslens-checkpoint-")
        warnings.warn(f"spark.checkpoint.dir isn't set; checkpoints of this machine go to {found}", stacklevel=2)
        context.setCheckpointDir(found)
    return df.checkpoint()
