"""The same functions on streams: they keep no state, so a stream of files or messages needs nothing else."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id bigint, url string, html string", files: int = 100) -> DataFrame:
    """Pages as Parquet files arrive in a folder, so many files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def text_counts(texts: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 hour", **values: Column) -> DataFrame:
    """(start, n, ...) for windows of time; rows that come later than `late` are not waited for."""
    return texts.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in values.items())).select(F.col("window.start").alias("start"), "n", *values)


def to_folder(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of Parquet files that takes up where it left off; what is there now is one run of it."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
