"""Late rows of a stream are kept aside, and what is in time gives the sessions of a batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sealmark.streaming import jobs

EVENTS = "id long, session_id string, ts timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_late_rows_and_sessions(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rnd, base = random.Random(4), str(tmp_path)
    parts = [[(100 * p + i, f"s{rnd.randrange(5)}", at(600 * p + rnd.randrange(-900 if p else 0, 600))) for i in range(60)] for p in range(4)]
    parts[2].append((999, "s1", None))
    lateness, idle, absolute = 240 * 60, 60 * 60, 300 * 60
    for part in parts:
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(f"{base}/arrived")
        main, side = jobs.route_late(spark.readStream.schema(EVENTS).parquet(f"{base}/arrived"), f"{base}/routed", f"{base}/marks", lateness)
    newest, want = None, set()
    for part in parts:
        want |= {i for i, _, t in part if t is None or (newest is not None and t < newest - dt.timedelta(seconds=lateness))}
        newest = max(t for x in (part, [(0, "", newest)]) for _, _, t in x if t is not None)
    late, kept = {r.id for r in side.collect()}, {r.id for r in main.collect()}
    assert late == want and len(late) > 5 and late.isdisjoint(kept) and late | kept == {i for part in parts for i, _, _ in part}
    # a second run finds nothing new
    again = jobs.route_late(spark.readStream.schema(EVENTS).parquet(f"{base}/arrived"), f"{base}/routed", f"{base}/marks", lateness)
    assert {r.id for r in again[1].collect()} == late
    # the session stream over the rows in time drops none of them
    source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{base}/routed/on_time")
    got = jobs.run_to_parquet(jobs.session_expiry_stream(source.select("session_id", "ts"), idle, absolute, f"{lateness} seconds"), f"{base}/rows", f"{base}/sessions")
    assert got.count() > 5 and got.agg(F.sum("n_steps")).first()[0] <= len(kept)
