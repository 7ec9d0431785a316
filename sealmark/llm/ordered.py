"""Places and running sums in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.scratch import written


def in_parts(df: DataFrame, what: str, *order: Column | str) -> DataFrame:
    """df range-sorted and written, with `part` (rising with the order) and `at` (rising, within a part gapless)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(ordered.withColumn("part", F.shiftright("at", 33)), what)


def with_sums(df: DataFrame, what: str, *order: Column | str, **sums: Column) -> DataFrame:
    """df with, for each of sums, its total over the rows before (0 for the first), and `all_<name>`, its total over all.

    Totals are made per part of a range sort; only these, a row per part, pass through one window.
    """
    rows = in_parts(df, what, *order)
    per = rows.groupBy(F.col("part").alias("of_part")).agg(*(F.sum(c).alias(f"own_{n}") for n, c in sums.items()))
    before, whole = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select("of_part", *(F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)).alias(f"upto_{n}") for n in sums), *(F.sum(f"own_{n}").over(whole).alias(f"all_{n}") for n in sums))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{n}") for n, c in sums.items()))
    rows = rows.join(F.broadcast(per), F.col("part") == F.col("of_part"))  # a row per part
    return rows.select(*df.columns, *((F.col(f"upto_{n}") + F.col(f"in_{n}")).alias(n) for n in sums), *(f"all_{n}" for n in sums))
