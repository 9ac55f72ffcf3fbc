"""File catalogue source and report sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def catalog_scan(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """Files under ``root``, one pass per extension; a file matched twice is listed twice.

    Only path and length are selected, so no file content is read.
    """
    def one(ext):
        return (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}")
                .option("recursiveFileLookup", str(recursive).lower()).load(root)
                .select("path", F.col("length").alias("size_bytes"), F.lit(ext).alias("extension")))
    found = reduce(DataFrame.unionByName, [one(e) for e in extensions])
    return found.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def write_report(tables: dict[str, DataFrame], out: str, run: str = "") -> None:
    """Write the report tables of one run in one job, a partition for each run and table.

    Only the run's own partitions are replaced, so a repeated run leaves the folder as it
    was and other runs stay. All tables share one schema; a column that a table lacks is null.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("table", F.lit(name)) for name, df in tables.items()])
    keys = ["run", "table"] if run else ["table"]
    rows = rows.withColumn("run", F.lit(run)) if run else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(out)


def read_report(spark: SparkSession, out: str, run: str, table: str | None = None) -> DataFrame:
    """The rows of a run, of all its tables or of one; only their partitions are read."""
    rows = spark.read.parquet(out).filter(F.col("run") == run)
    return rows if table is None else rows.filter(F.col("table") == table)
