"""Cutting lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; on one machine without it, under the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tokenlake-{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df with each key's rows in one task and the keys over all tasks, to write a file for each key.

    Such a write costs by files, not by bytes, so the number of tasks is given: adaptive execution would join small ones into one.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet in a new folder, parted by its last columns if they are named, and read again; removed() deletes it."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete the files behind tables of stored(); what reads them must have been written elsewhere."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
