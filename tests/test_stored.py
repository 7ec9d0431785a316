"""A stored table of attempts: merges, retention and erasure touch only the buckets they must."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from sealmark.operators import stored, stores

STEPS = "session_id string, seq long, ts timestamp, user_id string, decision string, client_ip string"


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def steps(rnd, n, sessions, start):
    return [(f"s{rnd.randrange(sessions)}", start + i, at(start + i), f"u{rnd.randrange(20)}", rnd.choice(["passed", "pending", "rejected"]), rnd.choice(["a", "b", "", None])) for i in range(n)]


def files(path):
    return {f.parent.name: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}, {f"{f.parent.name}/{f.name}" for f in Path(path).rglob("*.parquet")}


def test_merges_equal_one_aggregation_and_leave_other_buckets(spark, tmp_path):
    rnd, path = random.Random(2), str(tmp_path / "attempts")
    first, more = steps(rnd, 400, 120, 0), steps(rnd, 6, 120, 1000)
    stored.create(stores.attempt_upsert(spark.createDataFrame(first, STEPS)), path, 16)
    before, names = files(path)
    assert len(before) == 16
    touched = stored.merge(spark, spark.createDataFrame(more, STEPS), path, 16)
    after, names_after = files(path)
    assert 0 < len(touched) <= 6 and {b for b in before if before[b] == after[b]} == {f"bucket={k}" for k in range(16) if k not in touched}
    assert len(names & names_after) == 16 - len(touched)
    rows = lambda df: sorted(map(tuple, stores.attempt_rows(df).collect()))
    assert rows(stored.read(spark, path)) == rows(stores.attempt_upsert(spark.createDataFrame(first + more, STEPS)))
    assert stored.merge(spark, spark.createDataFrame([], STEPS), path, 16) == []
    assert files(path)[0] == after


def test_purge_and_erasure_write_what_they_touch(spark, tmp_path):
    rnd, path = random.Random(5), str(tmp_path / "attempts")
    first = steps(rnd, 300, 60, 0)
    stored.create(stores.attempt_upsert(spark.createDataFrame(first, STEPS)), path, 32)
    whole = {r.session_id: r for r in stores.attempt_rows(stored.read(spark, path)).collect()}
    before, _ = files(path)
    old = {s for s, r in whole.items() if r.updated_at < at(240)}
    touched, n = stored.remove(spark, path, F.col("last.at.ts") < F.lit(at(240)))
    after, _ = files(path)
    assert n == len(old) > 0 and {b for b in after if after[b] != before[b]} == {f"bucket={k}" for k in touched}
    assert stored.remove(spark, path, F.col("last.at.ts") < F.lit(at(240))) == ([], 0)
    gone = spark.createDataFrame([("u1",), ("u2",), ("u1",), ("nobody",)], "user_id string")
    touched, n = stored.remove(spark, path, gone)
    left = {r.session_id: r for r in stores.attempt_rows(stored.read(spark, path)).collect()}
    assert set(left) == {s for s, r in whole.items() if s not in old and r.user_id not in ("u1", "u2")} and n == len(whole) - len(old) - len(left)
    # a table from which all went, and one that comes back
    stored.remove(spark, path, F.lit(True))
    assert stored.read(spark, path).count() == 0 and len(files(path)[0]) == 32
    stored.merge(spark, spark.createDataFrame(first, STEPS), path, 32)
    assert {r.session_id for r in stored.read(spark, path).collect()} == set(whole)
