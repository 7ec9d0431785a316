"""The two-level limiter on calls without a gap over the window: no task holds the whole key."""

import datetime as dt

import numpy as np
import pytest

from sealmark.operators import throttle

START = dt.datetime(2024, 1, 1)


def calls(spark, n, gap):
    at = np.cumsum(np.random.default_rng(4).integers(0, gap, n))
    return [(i, START + dt.timedelta(seconds=int(s)), f"c{i % 7 % 3}") for i, s in enumerate(at)]


def plain(rows, window, most_global, most_client):
    logs, out = {}, {}
    for i, t, client in sorted(rows, key=lambda r: (r[1], r[0])):
        out[i] = "OK"
        for key, most, outcome in (("", most_global, "GLOBAL"), (client, most_client, "CLIENT")):
            log = [x for x in logs.get(key, []) if (t - x).total_seconds() <= window]
            if len(log) >= most:
                out[i] = outcome
                break
            logs[key] = [*log, t]
    return out


@pytest.mark.parametrize("gap", [4, 60])
def test_dense_calls_in_slices(spark, monkeypatch, gap):
    monkeypatch.setattr(throttle, "SLICE_CALLS", 500)
    sizes = []
    decided = throttle._decided
    monkeypatch.setattr(throttle, "_decided", lambda rows, *a: sizes.append(rows.groupBy("key").count().agg({"count": "max"}).first()[0]) or decided(rows, *a))
    rows = calls(spark, 3000, gap)
    df = spark.createDataFrame(rows, "call_id long, ts timestamp, client_ip string")
    got = {r.call_id: r.outcome for r in throttle.two_level_limit(df, 120, 9, 2).collect()}
    assert got == plain(rows, 120, 9, 2) and {"OK", "GLOBAL" if gap == 4 else "OK"} <= set(got.values())
    assert sizes[0] < 1000  # the largest slice of the global key


def test_log_goes_on_through_batches():
    us = np.sort(np.random.default_rng(3).integers(0, 10**6, 4000))
    log, parts = throttle.deque(), []
    for k in range(0, 4000, 37):
        parts.append(throttle.admitted(us[k : k + 37], 5000, 6, log))
    assert (np.concatenate(parts) == throttle.admitted(us, 5000, 6)).all()


def test_slices_are_folded_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(throttle, "SLICE_CALLS", 100)
    monkeypatch.setattr(throttle, "_ends", lambda window, most, logs, ends=throttle._ends: folded.extend(logs) or ends(window, most, logs))
    folded, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = calls(spark, 2000, 4)
        got = {r.call_id: r.outcome for r in throttle.two_level_limit(spark.createDataFrame(rows, "call_id long, ts timestamp, client_ip string"), 120, 9, 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows, 120, 9, 2)
    assert len(set(folded)) > 15 and len(folded) <= 3 * len(set(folded))  # calls under a limit that always bites
