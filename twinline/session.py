"""Session defaults and the one place that reads the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | None = None, name: str = "twinline") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master that names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_twinline_folder", None) or tempfile.mkdtemp(prefix="twinline-")
        spark._twinline_folder = base
    return base.rstrip("/")


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by key for grouped Python work.

    Such work is bound by CPU, not bytes; without this, small inputs would be
    merged into one partition and run in a single Python process. The grouping
    that follows has the same keys, so there is still one shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors, and gives the plans after
    it real sizes to choose joins by.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
