"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a new temporary folder takes its place, but on one machine only: elsewhere
    executors would not see it, and that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage is cut, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    # No later query reads this one's shuffle files, so they go when it has ended.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and that no result still to be computed reads."""
    for table in tables:
        spark = table.sparkSession
        prefix = f"{shared_dir(spark)}/t-".split(":")[-1].lstrip("/")
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if prefix in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores so that it clashes with no column of df (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly this name (dots and backticks in it are no syntax)."""
    return F.col("`" + name.replace("`", "``") + "`")
