"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str, spread: bool = False) -> DataFrame:
    """``root/name.parquet``, a file or a folder of part files.

    With ``spread``, for plans that work long on each row, an input of fewer
    partitions than there are cores is dealt out over the cores first; such an
    input is small, and a larger one is left as it lies.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
