"""Session helpers: UTC session, reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "skyledger") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder: on a
    cluster, executors would write to their own disks.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="skyledger-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of a small table, about, and the partitions it keeps at least.
PACK, FEW = 1 << 16, 8


def partitions_for(rows: int) -> int:
    """Partitions that a table of so many short rows needs."""
    return max(FEW, -(-rows // PACK))


def packed(df: DataFrame) -> DataFrame:
    """``cut``, then in no more partitions than the rows (short ones) need: each partition is files of every later shuffle."""
    out = cut(df)
    return out.coalesce(partitions_for(out.count()))


#: Independent steps whose jobs are submitted together; each may hold a model in the driver.
AT_ONCE = 3


def at_once(spark: SparkSession, steps: Iterable[Callable[[], object]]) -> list:
    """Results of independent steps, a few at a time, so that small jobs do not wait for each other's driver work."""
    run = inheritable_thread_target(spark)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [done.result() for done in [pool.submit(run(step)) for step in steps]]
