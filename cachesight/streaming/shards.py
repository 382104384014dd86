"""Shards that arrive over time: mergeable sums for each batch of files, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.functions.scalars import finite
from cachesight.schema import SCHEMA


def partial_sums(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """What numeric summaries of several batches can be made of."""
    x = F.when(finite(F.col(column)), F.col(column))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(~F.coalesce(finite(F.col(column)), F.lit(False))).alias("missing"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.min(x).alias("least"), F.max(x).alias("largest"))


def merge_sums(parts: DataFrame, by: list[str]) -> DataFrame:
    """Means and population deviations (of a variance that is never below zero)."""
    n, s = F.sum("n"), F.sum("s")
    mean = F.try_divide(s, n)
    return parts.groupBy(*by).agg(n.alias("n"), F.sum("missing").alias("missing"), F.round(mean, 9).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("ss"), n) - mean * mean)), 9).alias("std"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def ingest(spark: SparkSession, folder: str, checkpoint: str, sums: str, column: str, by: list[str], files_per_batch: int = 16):
    """Start a query that adds the sums of new Parquet shards to the table ``sums``; stops when all files are read.

    A batch overwrites only its own folder, so a batch that runs again after a failure counts once.
    """
    shards = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, column, by).write.mode("overwrite").parquet(f"{sums}/batch={number}")

    return shards.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
