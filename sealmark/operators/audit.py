"""Tamper-evident audit logs: canonical form, chained hashes, parallel verification, reports."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.functions.scalars import hmac_sha256

GENESIS = "0" * 64


def canonical(events: DataFrame, detail: str = "detail") -> Column:
    """The event as JSON: keys sorted, no blanks, ASCII. Columns: event_time, event_type, actor, action, subject, and
    detail, a struct with sorted fields or null."""
    at = F.date_format(F.col("event_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    plain = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
    body = F.coalesce(F.to_json(F.col(detail), plain), F.lit("{}"))
    head = F.to_json(F.struct("action", "actor"), plain)
    tail = F.to_json(F.struct("subject", at.alias("t"), F.col("event_type").alias("type")), plain)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"detail":'), body, F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))


def chain_key(secret: bytes) -> bytes:
    return hashlib.sha256(secret + b"|audit-chain").digest()


def entry_hash(prev: Column, text: Column, key: bytes | None = None) -> Column:
    message = F.concat(prev, F.lit("|"), text)
    return F.sha2(message, 256) if key is None else hmac_sha256(key, message)


def append(events: DataFrame, key: bytes | None = None, chain: str = "chain") -> DataFrame:
    """events (chain, seq, canonical) with prev_hash and entry_hash.

    A chain is sequential by nature; one chain per value of `chain` (a tenant, a day) is what runs in parallel. Rows
    stream through a chain in order of seq; only the last hash is held.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", prev_hash string, entry_hash string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for batch in batches:
            prev, entry = [], []
            for c, text in zip(batch.column(batch.schema.get_field_index(chain)).to_pylist(), batch.column(batch.schema.get_field_index("canonical")).to_pylist()):
                if c != now:
                    now, last = c, GENESIS
                message = f"{last}|{text}".encode()
                prev.append(last)
                last = hmac.new(key, message, "sha256").hexdigest() if key else hashlib.sha256(message).hexdigest()
                entry.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prev), pa.array(entry)], [*batch.schema.names, "prev_hash", "entry_hash"])

    ordered = events.repartition(chain).sortWithinPartitions(chain, "seq")
    return ordered.mapInArrow(fold, schema)


def verify(log: DataFrame, key: bytes | None = None, chain: str = "chain") -> DataFrame:
    """One row per chain: chain, is_ok, entries, broken_at (its first seq whose link or hash is wrong).

    Hashes are recomputed by columns. For links, rows are range-partitioned by chain and seq, so a long chain is
    checked by several tasks; each hands on one row per chain that it holds, and only those meet. Gaps in seq are fine.
    """
    forged = F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("canonical"), key)
    rows = log.select(F.col(chain).alias("chain"), "seq", "prev_hash", "entry_hash", F.coalesce(forged, F.lit(True)).alias("forged"))
    parts = max(2, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "chain", "seq").sortWithinPartitions("chain", "seq")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            chains, seq, prev, entry = (batch.column(k) for k in range(4))
            same = pc.fill_null(pc.equal(chains.slice(1), chains.slice(0, n - 1)), False)
            linked = pc.fill_null(pc.equal(prev.slice(1), entry.slice(0, n - 1)), False)
            new = np.concatenate(([True], ~same.to_numpy(zero_copy_only=False)))
            wrong = np.concatenate(([False], ~linked.to_numpy(zero_copy_only=False))) & ~new | batch.column(4).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            last = np.append(first[1:], n) - 1
            bad = np.flatnonzero(wrong)
            at = np.searchsorted(bad, first)  # the first wrong row from the run's start on
            has = at < len(bad)
            has[has] = bad[at[has]] <= last[has]
            broken = pa.array(np.where(has, bad[np.minimum(at, max(len(bad) - 1, 0))] if len(bad) else 0, 0), mask=~has)
            yield pa.RecordBatch.from_arrays(
                [chains.take(pa.array(first)), seq.take(pa.array(first)), prev.take(pa.array(first)), entry.take(pa.array(last)), seq.take(broken), pa.array(last - first + 1)],
                ["chain", "first_seq", "first_prev", "last_entry", "bad", "n"],
            )

    kind = rows.schema["chain"].dataType.simpleString()
    runs = ordered.mapInArrow(scan, f"chain {kind}, first_seq long, first_prev string, last_entry string, bad long, n long")
    # one row per chain and batch of rows
    before = F.coalesce(F.lag("last_entry").over(Window.partitionBy("chain").orderBy("first_seq")), F.lit(GENESIS))
    bad = F.least(F.when(F.col("first_prev") != before, F.col("first_seq")), F.col("bad"))
    out = runs.withColumn("bad", bad).groupBy("chain").agg(F.min("bad").alias("broken_at"), F.sum("n").alias("entries"))
    return out.select("chain", F.col("broken_at").isNull().alias("is_ok"), "entries", "broken_at")


def newest(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(max(1, min(500, limit)))


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type", "action").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"))


def failures_by_actor(log: DataFrame, failed_type: str) -> DataFrame:
    return log.where(F.col("event_type") == failed_type).groupBy("actor").agg(F.count("*").alias("failures"), F.max("event_time").alias("last_at"))


def governance_event(counts: DataFrame, action: str, at: Column) -> DataFrame:
    """An audit event for a purge or erase job, from its one row of counts."""
    return counts.select(at.alias("event_time"), F.lit("governance").alias("event_type"), F.lit("system").alias("actor"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("subject"), F.struct(*sorted(counts.columns)).alias("detail"))
