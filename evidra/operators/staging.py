"""Sending the package to executors, cutting lineage, and numbering rows, in ways that hold for tables of any size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends the whole package to the executors, once for each application, so that tasks can import any part of it.

    One archive: of two that hold parts of one package a worker would see the first alone.
    """
    sc = spark.sparkContext
    if getattr(sc, "_evidra_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="evidra-"), "evidra_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for f in sorted(names):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("evidra", os.path.relpath(folder, top), f))
    sc.addPyFile(to)
    sc._evidra_shipped = True


def _checkpoint_dir(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="evidra-")
    sc.setCheckpointDir(told)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder: what follows starts from there, on any executor."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def consecutive(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in that order, without a window over all rows.

    Rows are dealt by ranges; one number for each range reaches the driver.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect()):
        before.append(F.struct(F.lit(part).alias("k"), F.lit(total).cast("long").alias("v")))
        total += n
    if not before:
        return df.withColumn(name, F.lit(None).cast("long"))
    return dealt.withColumn(name, F.col("_at") + F.map_from_entries(F.array(*before))[F.col("_part")]).drop("_part", "_at")
