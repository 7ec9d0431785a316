"""Queries that run the given event table as a stream; their rows are those of the batch forms.

The table arrives in three parts, by time; each is a run of the same query from its checkpoint, so state is carried
from micro-batch to micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealmark.operators import stores
from sealmark.plans import burst_queries, store_queries, throttle_queries
from sealmark.plans.bindings import TEXTS, oracle, table
from sealmark.scratch import shared_dir
from sealmark.streaming import jobs

PARTS = 3


def _run(spark, sf, make, run=jobs.run_to_parquet):
    """The rows of make(events as a stream) after all parts have arrived."""
    jobs.use_rocksdb(spark)
    folder = f"{shared_dir(spark)}/sealmark/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = sorted(events.approxQuantile("arrival", [k / PARTS for k in range(1, PARTS)], 0.01))
    out = None
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
        part = events.where((F.col("arrival") >= low) & (F.col("arrival") < high)).drop("arrival")
        part.write.mode("append").parquet(f"{folder}/arrived")
        stream = make(spark.readStream.schema(part.schema).parquet(f"{folder}/arrived"))
        out = run(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return out


def _steps(spark, events):
    return spark.sql(TEXTS["steps"], events=events)


def s_f1_limit_stream(spark, sf):
    return _run(spark, sf, lambda events: jobs.limit_stream(spark.sql(TEXTS["calls"], events=events), throttle_queries.DAY, 2))


def s_f2_two_level_stream(spark, sf):
    return _run(spark, sf, lambda events: jobs.two_level_stream(spark.sql(TEXTS["calls"], events=events), 3600, 9, 2))


def s_f4_code_stream(spark, sf):
    return _run(spark, sf, lambda events: jobs.code_stream(spark.sql(TEXTS["contacts"], events=events), 3 * throttle_queries.DAY, 2))


def s_d7_replay_stream(spark, sf):
    """Event ids rise with time, so a session's attempts arrive in order of seq."""
    return _run(spark, sf, lambda events: jobs.replay_lock_stream(burst_queries.retries(_steps(spark, events))))


def s_e1_attempt_stream(spark, sf):
    return stores.attempt_rows(_run(spark, sf, lambda events: jobs.attempt_stream(_steps(spark, events)), jobs.run_complete))


IDLE, ABSOLUTE, LATE = 12 * 3600, 36 * 3600, 24 * 3600


def s_e6_session_stream(spark, sf):
    steps = lambda events: events.select(F.col("user_id").cast("string").alias("session_id"), "ts")
    return _run(spark, sf, lambda events: jobs.session_expiry_stream(steps(events), IDLE, ABSOLUTE, f"{LATE} seconds"))


FAR = 20 * 86400


def s_e6_late_rows(spark, sf):
    """Events in three parts that don't follow the time: each is in time, or kept aside as too late."""
    folder = f"{shared_dir(spark)}/sealmark/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "ts")
    for part in range(PARTS):
        events.where(F.col("event_id") % PARTS == part).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/arrived")
        main, side = jobs.route_late(stream, f"{folder}/routed", f"{folder}/checkpoint", FAR)
    return main.select("event_id", F.lit(False).alias("is_late")).union(side.select("event_id", F.lit(True)))


QUERIES = [s_e6_late_rows, s_f1_limit_stream, s_f2_two_level_stream, s_f4_code_stream, s_d7_replay_stream, s_e1_attempt_stream, s_e6_session_stream]
SQL = {
    "s_e6_late_rows": f"""WITH m AS (SELECT max(ts) FILTER (event_id % 3 = 0) AS m1, max(ts) FILTER (event_id % 3 <> 2) AS m2 FROM events)
 SELECT event_id, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN ts < m1 - INTERVAL {FAR} SECOND ELSE ts < m2 - INTERVAL {FAR} SECOND END AS is_late FROM events, m""",
    "s_f1_limit_stream": throttle_queries.SQL["f1_sliding_limit"], "s_f2_two_level_stream": throttle_queries.SQL["f2_two_level_limit"], "s_f4_code_stream": throttle_queries.SQL["f4_code_outcomes"],
    "s_d7_replay_stream": burst_queries.SQL["d7_replay_lock"], "s_e1_attempt_stream": store_queries.SQL["e1_attempt_upsert"],
    "s_e6_session_stream": f"""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS session_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT session_id, k, us AS first, us FROM o WHERE k = 1 UNION ALL SELECT o.session_id, o.k, CASE WHEN o.us - f.us > {IDLE}000000 OR o.us - f.first > {ABSOLUTE}000000 THEN o.us ELSE f.first END, o.us FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1),
 s AS (SELECT session_id, first, least(max(us) + {IDLE}000000, first + {ABSOLUTE}000000) AS ends, count(*) AS n_steps FROM f GROUP BY session_id, first)
 SELECT session_id, make_timestamp(first) AS started_at, make_timestamp(ends) AS ended_at, n_steps FROM s
 QUALIFY first < max(first) OVER (PARTITION BY session_id) OR ends // 1000 + 1 <= (SELECT max(us) // 1000 FROM o) - {LATE}000""",
}
