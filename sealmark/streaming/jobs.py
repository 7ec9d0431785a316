"""Streaming forms: attempts, session expiry, the limiters, one-time codes, the replay lock.

Each keyed fold keeps the state that its batch form holds in a loop, per key, in a RocksDB state store. Rows of a
micro-batch are folded in time order within their key. With ttl_seconds an idle key is forgotten after that time, by
the wall clock; such a stream wakes for its timers, so run it with a processing-time trigger, not availableNow.
"""

from __future__ import annotations

from collections import deque, namedtuple
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sealmark.operators.stores import attempt_upsert
from sealmark.operators.throttle import admitted
from sealmark.scratch import written

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Fold(StatefulProcessor):
    """A fold over the ordered rows of a key; `step(state, row)` gives (state, output row)."""

    def __init__(self, state_schema: str, columns: list[str], order: list[str], start: tuple, step, ttl_ms: int | None):
        self.state_schema, self.columns, self.order, self.start, self.step, self.ttl_ms = state_schema, columns, order, start, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # most keys have few rows: calls to the state store and to pandas are what they cost
        held = self.state.get()
        before = state = self.start if held is None else tuple(held)
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        values = {c: frame[c].to_numpy() for c in frame.columns}
        at = np.lexsort([values[c] for c in reversed(self.order)])
        row_of = namedtuple("Row", values)
        out = []
        for row in map(row_of._make, zip(*(v[at].tolist() for v in values.values()))):
            state, made = self.step(state, row)
            if made is not None:
                out.append((*key, *made))
        if self.ttl_ms is not None or state != before:
            self.state.update(state)
        if out:
            yield pd.DataFrame(dict(zip(self.columns, zip(*out))))

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, key: str, out: str, state: str, order: list[str], start: tuple, step, ttl_seconds: float | None) -> DataFrame:
    columns = [c.split()[0] for c in out.split(", ")]
    processor = _Fold(state, columns, order, start, step, None if ttl_seconds is None else int(ttl_seconds * 1000))
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="None" if ttl_seconds is None else "ProcessingTime")


class _TwoLevels(StatefulProcessor):
    """The two-level limiter's only key: of a call it holds 20 bytes (time, id, number of its client) and what sorting them takes."""

    def __init__(self, window: int, most_global: int, most_client: int, ttl_ms: int | None):
        self.window, self.most_global, self.most_client, self.ttl_ms = window, most_global, most_client, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "times array<long>, clients array<string>, passed array<boolean>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, numbers, parts = self.state.get(), {}, []
        log = [] if held is None else list(zip(*(part or [] for part in held)))
        for part in rows:
            untimed = part["us"].isna()
            if untimed.any():  # calls without a time are never let through, as in the batch form
                yield pd.DataFrame({"call_id": part.loc[untimed, "call_id"], "outcome": "GLOBAL"})
                part = part[~untimed]
            clients = np.fromiter((numbers.setdefault(c, len(numbers)) for c in part["client"]), np.int32, len(part))
            parts.append((part["us"].to_numpy().astype(np.int64), part["call_id"].to_numpy().astype(np.int64), clients))
        us, ids, clients = (np.concatenate(x) for x in zip(*parts))
        del parts
        at, names = np.lexsort((ids, us)), list(numbers)
        us, ids, clients = us[at], ids[at], clients[at]
        taken = admitted(us, self.window, self.most_global, deque(x[0] for x in log)) if self.most_global > 0 else np.zeros(len(us), bool)
        outcome = np.zeros(len(us), np.int8)
        for i in np.flatnonzero(taken).tolist():  # the others leave no trace
            now, client = int(us[i]), names[clients[i]]
            log = [x for x in log if x[0] >= now - self.window]
            free = sum(own == client and ok for _, own, ok in log) < self.most_client
            log.append((now, client, free))
            outcome[i] = 2 if free else 1
        log = [x for x in log if not len(us) or x[0] >= int(us[-1]) - self.window]
        self.state.update(tuple([x[k] for x in log] for k in range(3)))
        words = np.array(["GLOBAL", "CLIENT", "OK"], object)
        for a in range(0, len(ids), 100_000):
            yield pd.DataFrame({"call_id": ids[a : a + 100_000], "outcome": words[outcome[a : a + 100_000]]})

    def close(self) -> None:
        pass


def limit_stream(calls: DataFrame, window_seconds: float, most: int, key: str = "key", ts: str = "ts", call_id: str = "call_id", ttl_seconds: float | None = None) -> DataFrame:
    """Streaming sliding-window limiter: (key, call_id, admitted). The state holds at most `most` times."""
    rows = calls.select(F.col(key).cast("string").alias("key"), F.col(call_id).alias("call_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    window = int(window_seconds * 1e6)

    def step(state, row):
        log = [t for t in (state[0] or []) if t >= row.us - window]
        ok = most <= 0 or len(log) < most
        return ([*log, int(row.us)] if ok and most > 0 else log,), (row.call_id, ok)

    return _folded(rows, "key", "key string, call_id long, admitted boolean", "log array<long>", ["us", "call_id"], ([],), step, ttl_seconds)


def two_level_stream(calls: DataFrame, window_seconds: float, most_global: int, most_client: int, client: str = "client_ip", ts: str = "ts", call_id: str = "call_id", ttl_seconds: float | None = None) -> DataFrame:
    """Streaming two-level limiter: (call_id, outcome), GLOBAL or CLIENT limited, or OK.

    All calls count against one number, so they pass one key; its state holds the at most most_global calls that took
    a global slot within the window, each with its client and whether that let it through.
    """
    rows = calls.select(F.lit("all").alias("key"), F.coalesce(F.col(client).cast("string"), F.lit("")).alias("client"), F.col(call_id).alias("call_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    processor = _TwoLevels(int(window_seconds * 1e6), most_global, most_client, None if ttl_seconds is None else int(ttl_seconds * 1000))
    return rows.groupBy("key").transformWithStateInPandas(processor, outputStructType="call_id long, outcome string", outputMode="Append", timeMode="None" if ttl_seconds is None else "ProcessingTime")


def code_stream(events: DataFrame, ttl_seconds: float, most_attempts: int, key: str = "session_id", state_ttl_seconds: float | None = None) -> DataFrame:
    """Streaming one-time codes: (session_id, seq, outcome) of confirm events."""
    rows = events.select(F.col(key).cast("string").alias("session_id"), "seq", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.sha2(F.concat_ws(":", F.col(key), F.col("code")), 256).alias("code_hash"))
    ttl = int(ttl_seconds * 1e6)

    def step(state, row):
        code, until, attempts, used = state
        if row.kind == "issue":
            return (row.code_hash, int(row.us) + ttl, 0, False), None
        if code is None:
            return state, (row.seq, "NO_CONTACT_CHALLENGE")
        if row.us > until:
            return (None, 0, 0, False), (row.seq, "CODE_EXPIRED")
        if attempts >= most_attempts:
            return (None, 0, 0, False), (row.seq, "TOO_MANY_ATTEMPTS")
        if used:
            return state, (row.seq, "CODE_ALREADY_USED")
        good = row.code_hash == code
        return (code, until, attempts + 1, good), (row.seq, "OK" if good else "CODE_INVALID")

    return _folded(rows, "session_id", "session_id string, seq long, outcome string", "code string, until long, attempts int, used boolean", ["us", "seq"], (None, 0, 0, False), step, state_ttl_seconds)


def replay_lock_stream(attempts: DataFrame, key: str = "session_id", ttl_seconds: float | None = None) -> DataFrame:
    """Streaming replay lock: (session_id, seq, locked, passed)."""
    checks = ("frame", "display", "paper", "heuristic")
    rows = attempts.select(F.col(key).cast("string").alias("session_id"), "seq", "passed", "replay", "other_signals", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in checks))

    def step(state, row):
        n = int(row.replay) + int(row.other_signals)
        if state[0]:
            clean = bool(row.passed and not n and row.frame <= 0.24 and row.display <= 0.6 and row.paper <= 0.34 and row.heuristic <= 0.44)
            return (not clean,), (row.seq, not clean, clean)
        locked = bool(row.replay)
        return (locked,), (row.seq, locked, bool(row.passed and not n))

    return _folded(rows, "session_id", "session_id string, seq long, locked boolean, passed boolean", "locked boolean", ["seq"], (False,), step, ttl_seconds)


def attempt_stream(steps: DataFrame) -> DataFrame:
    """Streaming attempt rows (update or complete mode): the batch aggregation is a stream's too."""
    return attempt_upsert(steps)


class _Expiry(StatefulProcessor):
    """Open session of a key: first and last time and number of steps. It closes by a later step, or by a timer."""

    def __init__(self, idle: int, absolute: int):
        self.idle, self.absolute = idle, absolute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "first long, last long, n long")

    def _closed(self, key: Any, first: int, last: int, n: int) -> tuple:
        return key[0], first, min(last + self.idle, first + self.absolute), n

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out = tuple(self.state.get()) if self.state.exists() else None, []
        for us in sorted(int(x) for part in rows for x in part["us"]):
            if now is not None and (us - now[1] > self.idle or us - now[0] > self.absolute):
                out.append(self._closed(key, *now))
                now = None
            now = (us, us, 1) if now is None else (now[0], us, now[2] + 1)
        self.state.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(min(now[1] + self.idle, now[0] + self.absolute) // 1000 + 1)
        yield pd.DataFrame(out, columns=["session_id", "first", "end", "n_steps"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            out.append(self._closed(key, *self.state.get()))
            self.state.clear()
        yield pd.DataFrame(out, columns=["session_id", "first", "end", "n_steps"])

    def close(self) -> None:
        pass


def session_expiry_stream(steps: DataFrame, idle_seconds: float = 1800, absolute_seconds: float = 7200, lateness: str = "10 minutes") -> DataFrame:
    """(session_id, started_at, ended_at, n_steps) once a session was idle, or open, for longer than allowed.

    A session kept busy beyond its absolute age ends too; the next step starts another. Steps later than `lateness`
    are dropped: route_late() keeps them aside. Times are of event time.
    """
    rows = steps.select(F.col("session_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness)
    processor = _Expiry(int(idle_seconds * 1e6), int(absolute_seconds * 1e6))
    out = rows.groupBy("session_id").transformWithStateInPandas(processor, outputStructType="session_id string, first long, end long, n_steps long", outputMode="Append", timeMode="EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("session_id", at("first").alias("started_at"), at("end").alias("ended_at"), "n_steps")


def route_late(rows: DataFrame, folder: str, checkpoint: str, lateness_seconds: float, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Process what the source holds now, and keep what a stateful query would drop: (rows in time, rows too late) so far.

    A row is late when it lies further than lateness_seconds behind the newest time of the micro-batches before its
    own, as the watermark of a stateful query has it; so is a row without a time. Rows in time are in <folder>/on_time,
    which a stateful query with the same lateness reads without dropping any, and late ones in <folder>/late. Each
    micro-batch replaces its own folders, so one that is repeated leaves the same.
    """
    spark, us = rows.sparkSession, F.unix_micros(F.col(ts).cast("timestamp"))

    def route(batch: DataFrame, nr: int) -> None:
        newest = spark.read.parquet(f"{folder}/newest/{nr - 1}").first().us if nr else None
        late = us.isNull() if newest is None else F.coalesce(us < newest - int(lateness_seconds * 1e6), F.lit(True))
        held = written(batch, "batch")
        held.where(~late).write.mode("overwrite").parquet(f"{folder}/on_time/{nr}")
        held.where(late).write.mode("overwrite").parquet(f"{folder}/late/{nr}")
        held.agg(F.greatest(F.max(us), F.lit(newest).cast("long")).alias("us")).write.mode("overwrite").parquet(f"{folder}/newest/{nr}")

    rows.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(rows.schema).option("recursiveFileLookup", True)
    return done.parquet(f"{folder}/on_time"), done.parquet(f"{folder}/late")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what the source holds now and return it as a table, in a session's memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now into Parquet files and return these."""
    query = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now; path holds the whole result after every micro-batch."""
    write = lambda rows, nr: rows.write.mode("overwrite").parquet(f"{path}/{nr % 2}")  # noqa: E731 (the one before stays readable)
    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return stream.sparkSession.read.parquet(f"{path}/{last % 2}")
