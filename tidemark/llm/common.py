"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: a word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir; where that is unset, a folder
    below the warehouse serves, unless that lies on one machine of several.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        on_one_machine = warehouse.startswith(("file:", "/")) or ":" not in warehouse
        if on_one_machine and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = warehouse + "/_scratch"
    return root.rstrip("/")


def durable(frame: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without repeating
    the work before, and every reader sees the same rows.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def whole_row(frame: DataFrame) -> Column:
    """All columns of a frame in one struct, out of the way of helper columns; `.*` brings them back."""
    return F.struct(*[frame[f"`{c.replace('`', '``')}`"] for c in frame.columns])


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    """A double in [0, 1) that depends on the parts alone."""
    hashed = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
