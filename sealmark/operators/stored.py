"""Attempts as a stored table that is merged bucket by bucket: files of buckets that nothing touches stay as they are.

The table is Parquet, partitioned by `bucket`, a hash of the session, and holds the state that attempt_upsert() merges.
Rows are written to the shared folder first, and then replace their buckets by dynamic partition overwrite, so that a
lost executor or a repeated task leaves each bucket whole. A bucket keeps one row without a session, so that one from
which all rows went is written too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.operators.stores import attempt_upsert
from sealmark.scratch import written

BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def create(state: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store the rows of attempt_upsert()."""
    everything = state.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _replace(state.withColumn("bucket", _bucket(buckets)), everything, path)


def _replace(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Write rows in place of the touched buckets."""
    marks = touched.select("bucket", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"))
    whole = rows.unionByName(marks).repartition("bucket").sortWithinPartitions("bucket", "session_id")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The stored state; with `only`, of these buckets, whose folders alone are read."""
    rows = spark.read.parquet(path)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    return rows.where("session_id is not null")


def _touched(rows: DataFrame) -> list[int]:
    """The buckets that rows lie in: as many numbers as there are buckets, at most."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def merge(spark: SparkSession, steps: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Merge new steps into the table at path; gives the buckets that were written."""
    new = written(attempt_upsert(steps).withColumn("bucket", _bucket(buckets)), "steps")
    numbers = _touched(new)
    if numbers:
        both = new.unionByName(read(spark, path, numbers))
        _replace(written(_merged(both), "merged"), spark.createDataFrame([(b,) for b in numbers], "bucket int"), path)
    return numbers


def _merged(states: DataFrame) -> DataFrame:
    """One state per session, of several: the aggregation of attempt_upsert(), which is associative."""
    return states.groupBy("session_id", "bucket").agg(
        F.max_by("last", "last.at").alias("last"), F.min("created_at").alias("created_at"), F.max_by("address", "address.at").alias("address"), F.sum("step_count").alias("step_count")
    )


def remove(spark: SparkSession, path: str, gone: Column | DataFrame, key: str = "user_id") -> tuple[list[int], int]:
    """Take rows out: those that a condition over the state admits (retention), or whose last user is in `gone` (erasure).

    Gives the buckets that were written and the number of rows that went. Only buckets with such rows are written.
    """
    rows = read(spark, path)
    if isinstance(gone, DataFrame):
        asked = gone.select(F.col(key).alias("asked_user")).distinct()
        lost = rows.join(asked, F.col("last.user_id") == F.col("asked_user"), "left_semi")
    else:
        lost = rows.where(gone)
    lost = written(lost.select("bucket", "session_id"), "lost")
    numbers = _touched(lost)
    if numbers:
        kept = read(spark, path, numbers).join(lost.select(F.col("session_id").alias("lost_session")), F.col("session_id") == F.col("lost_session"), "left_anti")
        _replace(written(kept, "kept"), spark.createDataFrame([(b,) for b in numbers], "bucket int"), path)
    return numbers, lost.count()
