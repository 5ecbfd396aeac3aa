"""Cutting lineage: tables written to the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read back; without one, under the warehouse, which all executors share too.

    The files stay until the driver ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/inkgrid/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
