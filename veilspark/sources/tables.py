"""Tables as they lie in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. One that makes fewer tasks than there are cores is dealt over all of them, as what is done with texts
    costs far more than moving them; a large table has more tasks than that and stays where it is. Filters and the choice of
    columns still reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
