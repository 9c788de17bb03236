"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", *, app: str = "tidemark", memory: str = "8g", scratch: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    scratch becomes spark.checkpoint.dir. Without it the session gets a new
    temporary folder, which is removed when Python ends.
    """
    if scratch is None:
        scratch = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{scratch}")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local partitions still spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_one_machine = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if on_one_machine and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse + "/_scratch"


def new_workspace(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the scratch root, never used before."""
    return f"{scratch_root(spark).rstrip('/')}/tidemark/{tag}-{uuid.uuid4().hex}"
