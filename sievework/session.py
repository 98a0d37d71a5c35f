"""Session conventions: tables, lineage cuts and sizes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the workers this package once a session; Spark's own file server distributes it."""
    sc = spark.sparkContext
    if getattr(sc, "_sievework_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="sievework-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    sc.addPyFile(path)
    sc._sievework_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where it names none, a fresh one on a single machine; a cluster is refused, since its executors could not read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not found:
        found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="sievework-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def reliable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint (never a local one: executors may be lost)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def parallelism(spark: SparkSession) -> int:
    """Partitions that a full shuffle should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only where the optimizer's own size estimate of ``df`` stays under ``limit_bytes``.

    Above the bound the plan is returned without a hint and the planner shuffles the join.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    return F.broadcast(df) if size <= limit_bytes else df
