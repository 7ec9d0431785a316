"""Throttles and one-time codes: keyed folds in time order, batch form."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealmark.scratch import written


#: Calls of a slice of the global key; there are at most as many slices as shuffle partitions.
SLICE_CALLS = 524_288


def admitted(micros: np.ndarray, window: int, most: int, log: deque | None = None) -> np.ndarray:
    """Which calls of a key are admitted: fewer than `most` admitted ones within `window` before them (ends included).

    Calls that are refused leave no trace. most <= 0 admits all. log: the admitted times that still count before the
    first call, brought up to the last one.
    """
    if most <= 0:
        return np.ones(len(micros), bool)
    out, log, i = np.zeros(len(micros), bool), deque() if log is None else log, 0
    times = micros.tolist()
    while i < len(times):
        while log and log[0] < times[i] - window:
            log.popleft()
        if len(log) < most:
            log.append(times[i])
            out[i] = True
            i += 1
        else:  # all calls up to the end of the oldest slot are refused
            i = max(i + 1, int(np.searchsorted(micros, log[0] + window, side="right")))
    return out


def _folded(batches: Iterator[pa.RecordBatch], window: int, most: int, logs: dict) -> Iterator[tuple]:
    """Batches of (key, call_id, us) in order of key, us and call_id, as (key, batch, admitted, log after the batch).

    Only the log of the key at hand is held; logs: what a key's log holds before its first call.
    """
    now, log = object(), deque()
    for batch in batches:
        keys, us = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                if keys[a] != now:
                    now, log = keys[a], deque(logs.get(keys[a], ()))
                ok = admitted(us[a:b], window, most, log)
                yield now, batch.slice(a, b - a), ok, log


def _decided(rows: DataFrame, window: int, most: int, logs: dict) -> DataFrame:
    """rows (key, call_id, us) with `admitted`; calls stream through a key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, ok, _ in _folded(batches, window, most, logs):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ok)], ["key", "call_id", "us", "admitted"])

    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("us"), "call_id")
    return ordered.mapInArrow(work, f"key {kind}, call_id long, us long, admitted boolean")


def sliding_window_limit(calls: DataFrame, window_seconds: float, most: int, key: str = "key", ts: str = "ts", call_id: str = "call_id") -> DataFrame:
    """(key, call_id, us, admitted) of every call. Only key, time and id move; a key's calls stream through one linear pass."""
    rows = calls.select(F.col(key).alias("key"), F.col(call_id).cast("long").alias("call_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return _decided(rows, int(window_seconds * 1e6), most, {})


def _sliced_limit(rows: DataFrame, window: int, most: int) -> DataFrame:
    """(key, call_id, us, admitted) of rows (call_id, us) under one key, where key is the number of a slice of time.

    Every slice is folded from the log that the slice before hands on, at most `most` times. Two rounds fold all slices
    whose incoming log is new, the first from empty logs: that settles all where logs meet or run empty. What is left is
    settled in order of time, a slice to a round, which reads that slice alone; so work grows with the calls.
    """
    base = written(rows, "calls")
    parts = min(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-base.count() // SLICE_CALLS)))
    sliced = base.repartitionByRange(parts, "us", "call_id").select(F.spark_partition_id().alias("key"), "call_id", "us")
    cut = written(sliced.sortWithinPartitions("key", "us", "call_id"), "slices", "key").select("key", "call_id", "us")
    firsts = {r.key: r.us for r in cut.groupBy("key").agg(F.min("us").alias("us")).collect()}
    order = sorted(firsts)
    used, handed, logs, todo, rounds = {}, {}, {k: [] for k in order}, order, 0

    while todo and most > 0:
        now = todo if rounds < 2 else todo[:1]
        part = cut.where(F.col("key").isin(now))
        part = part.repartition("key") if len(now) > 1 else part.coalesce(1)
        ends = part.sortWithinPartitions("key", "us", "call_id").mapInArrow(_ends(window, most, {k: logs[k] for k in now}), "key int, log array<long>")
        handed |= {r.key: r.log for r in ends.collect()}
        used |= {k: logs[k] for k in now}
        logs |= {b: [t for t in handed[a] if t >= firsts[b] - window] for a, b in zip(order[:-1], order[1:])}
        todo, rounds = [k for k in order if logs[k] != used[k]], rounds + 1
    return _decided(cut, window, most, logs)


def _ends(window: int, most: int, logs: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, []
        for key, _, _, log in _folded(batches, window, most, logs):
            if now is not None and key != now:
                yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.int32()), "log": pa.array([last], pa.list_(pa.int64()))})
            now, last = key, list(log)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.int32()), "log": pa.array([last], pa.list_(pa.int64()))})

    return work


def two_level_limit(calls: DataFrame, window_seconds: float, most_global: int, most_client: int, client: str = "client_ip", ts: str = "ts", call_id: str = "call_id") -> DataFrame:
    """(call_id, outcome): GLOBAL or CLIENT limited, or OK. A call takes its global slot even when its client is over.

    The global level never depends on clients, so it is folded first. Its only key is cut by time into slices, each
    a stream; see _sliced_limit. The rounds of that fold run at the call.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = calls.select(F.col(client).alias("client"), F.col(ts).alias("ts"), F.col(call_id).cast("long").alias("call_id"), us.alias("us"))
    first = _sliced_limit(rows.where("us is not null").select("call_id", "us"), int(window_seconds * 1e6), most_global).where("admitted").select("call_id")
    passed = rows.join(first, "call_id", "left_semi")
    second = sliding_window_limit(passed, window_seconds, most_client, "client").select("call_id", "admitted")
    out = rows.join(second, "call_id", "left")
    return out.select("call_id", F.when(F.col("admitted").isNull(), "GLOBAL").when(~F.col("admitted"), "CLIENT").otherwise("OK").alias("outcome"))


def offered_load(calls: DataFrame, window_seconds: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """calls with `offered`: the calls of the key in the window that ends with each, whatever became of them."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-window_seconds * 1_000_000, 0)
    return calls.withColumn("us", micros).withColumn("offered", F.count("*").over(w)).drop("us")


def code_outcomes(events: DataFrame, ttl_seconds: float, most_attempts: int, key: str = "session_id") -> DataFrame:
    """(session, seq, outcome) of every confirm event, folded with the issues before it, in order of ts and seq.

    NO_CONTACT_CHALLENGE, CODE_EXPIRED and TOO_MANY_ATTEMPTS (both drop the challenge), CODE_ALREADY_USED,
    CODE_INVALID, OK (the code is used up); the last two count as attempts. A new issue replaces the challenge.
    """
    # Within a challenge confirms are told apart by their number c: the first right one, and the one that drops it.
    rows = events.select(F.col(key).alias("session_id"), "seq", F.col("kind").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.sha2(F.concat_ws(":", F.col(key), F.col("code")), 256).alias("code_hash"))
    order = (F.asc_nulls_last("us"), F.col("seq"))
    upto = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    issue = F.when(F.col("kind") == "issue", F.struct("code_hash", (F.col("us") + int(ttl_seconds * 1e6)).alias("until")))
    rows = rows.select("*", F.count(issue).over(upto).alias("challenge"), F.last(issue, ignorenulls=True).over(upto).alias("issued")).where("kind is distinct from 'issue'")
    own = Window.partitionBy("session_id", "challenge")
    rows = rows.withColumn("c", F.row_number().over(own.orderBy(*order))).withColumn("expired", F.coalesce(F.col("us") > F.col("issued.until"), F.lit(False)))
    c, right = F.col("c"), (F.col("code_hash") == F.col("issued.code_hash")) & ~F.col("expired") & (F.col("c") <= most_attempts)
    rows = rows.select("*", F.min(F.when(right, c)).over(own).alias("used_at"), F.min(F.when(F.col("expired"), c)).over(own).alias("expires_at"))
    full_at = F.when(F.coalesce(F.col("used_at"), F.lit(most_attempts)) >= most_attempts, F.lit(max(most_attempts, 0) + 1))
    dropped_at = F.coalesce(F.least("expires_at", full_at), c + 1)  # least() passes over nulls
    outcome = (
        F.when((F.col("challenge") == 0) | (c > dropped_at), "NO_CONTACT_CHALLENGE").when((c == dropped_at) & F.col("expired"), "CODE_EXPIRED").when(c == dropped_at, "TOO_MANY_ATTEMPTS")
        .when(c == F.col("used_at"), "OK").when(c > F.col("used_at"), "CODE_ALREADY_USED").otherwise("CODE_INVALID")
    )
    return rows.select("session_id", "seq", outcome.alias("outcome"))


def nonce_checks(uses: DataFrame, issued: DataFrame) -> DataFrame:
    """(use_id, status): the first rule that a gesture completion breaks, 200 for the first valid use of a nonce.

    uses: use_id, session_id, challenge_id, nonce, passed, ts; issued: session_id, challenge_id, kind (active or
    hand), nonce, active_passed. 409 active-liveness id, 400 unknown id, 409 liveness not passed, 400 not passed,
    401 missing, unequal or used nonce.
    """
    given = issued.select("session_id", "challenge_id", "kind", F.col("nonce").alias("expected"), "active_passed")
    rows = uses.join(given, ["session_id", "challenge_id"], "left")
    valid = (F.col("kind") == "hand") & F.col("active_passed") & F.col("passed") & (F.col("nonce") == F.col("expected"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("session_id", "challenge_id", "valid").orderBy("ts", "use_id"))
    rows = rows.withColumn("nth", nth)
    status = (
        F.when(F.col("kind") == "active", 409).when(F.col("kind").isNull(), 400).when(~F.col("active_passed"), 409).when(~F.col("passed"), 400)
        .when(F.col("valid") & (F.col("nth") == 1), 200).otherwise(401)
    )
    return rows.select("use_id", status.alias("status"))


def slow_steps(timings: DataFrame, group: str, elapsed: str, slow_ms: float = 1000.0) -> DataFrame:
    """Per group: number, number of slow ones, mean and largest time."""
    return timings.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(elapsed) >= slow_ms).alias("slow"), F.avg(elapsed).alias("mean_ms"), F.max(elapsed).alias("max_ms"))
