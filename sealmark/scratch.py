"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sealmark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. by: columns whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sealmark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
