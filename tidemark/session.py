"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only on a local master where it is unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors share no folder to write to")
        current = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, so that reruns never overwrite each other."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    The files survive lost executors, and their size is known to later planning.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_ROWS, WIDE_ROWS = 20_000, 500_000  # of a core: fewer rows need no task of their own, more get files enough by their bytes


def cut_evenly(df: DataFrame, rows: int) -> DataFrame:
    """:func:`cut` with a file per core where the bytes alone would ask for fewer.

    A file is read by one task, and a fit is a job over the files per iteration.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = min(cores, rows // FILE_ROWS)
    return cut(df.repartition(files) if files > 1 and rows < cores * WIDE_ROWS else df)


def plan_bytes(df: DataFrame) -> int:
    """Estimated bytes behind a frame, without running a job.

    The smaller of the optimizer's estimate and the sum over the tables read: without column
    statistics the optimizer multiplies the two sides of every join, while all joins here are
    key lookups that never return more than their larger input.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(read, int(str(plan.stats().sizeInBytes())))


def in_parallel(spark: SparkSession, tasks: Iterable[Callable[[], R]], width: int = 4) -> list[R]:
    """Run independent Spark programs (folds, trials) side by side; results in order."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]
