"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.scratch import written

#: Edges per partition: small graphs aren't spread over more tasks than they need.
PART_EDGES = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between ids -> (node, component), component being the smallest id reachable.

    Null ends and self links are ignored; nodes without a link don't appear. Each round first hooks the
    larger neighbours of every node to the smallest of its neighbourhood, then the smaller ones, so that
    trees flatten to stars in about log(n) rounds. Only edges move; a hub's edges are summed by partial
    aggregation and joined by a join that adaptive execution can split.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, _mark(e)
    for _ in range(max_rounds):
        if now == before or not now.n:
            break
        parts = min(most, 1 + now.n // PART_EDGES)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct().coalesce(parts), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct().coalesce(parts), "stars")
        before, now = now, _mark(e)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v").alias("component")))


def _mark(e: DataFrame):
    """Number of edges and a sum of their hashes: equal for equal edge tables."""
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
