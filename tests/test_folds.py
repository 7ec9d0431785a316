"""One-time codes and the replay lock, which are written with windows, against plain folds over random events."""

import datetime as dt
import random

import pytest
from sealmark.operators import bursts, throttle


def plain_codes(events, ttl, most):
    out, state = [], {}
    for session, seq, minute, kind, code in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if kind == "issue":
            state[session] = [code, minute + ttl, 0, False]
            continue
        now = state.get(session)
        if now is None:
            out.append((session, seq, "NO_CONTACT_CHALLENGE"))
        elif minute > now[1]:
            state[session] = None
            out.append((session, seq, "CODE_EXPIRED"))
        elif now[2] >= most:
            state[session] = None
            out.append((session, seq, "TOO_MANY_ATTEMPTS"))
        elif now[3]:
            out.append((session, seq, "CODE_ALREADY_USED"))
        else:
            now[2] += 1
            now[3] = code == now[0]
            out.append((session, seq, "OK" if now[3] else "CODE_INVALID"))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_codes(spark, most):
    rnd = random.Random(most)
    events = [(f"s{rnd.randrange(8)}", i, rnd.randrange(60), "issue" if rnd.random() < 0.2 else "confirm", rnd.choice("123")) for i in range(500)]
    df = spark.createDataFrame([(s, i, dt.datetime(2024, 1, 1, 0, m), k, c) for s, i, m, k, c in events], "session_id string, seq long, ts timestamp, kind string, code string")
    got = sorted(map(tuple, throttle.code_outcomes(df, 9 * 60, most).collect()))
    assert got == plain_codes(events, 9, most)
    assert most < 2 or len({r[2] for r in got}) >= 5
    assert throttle.code_outcomes(df.limit(0), 60, most).collect() == []


def test_replay_lock(spark):
    rnd, rows = random.Random(6), []
    for i in range(600):
        calm = rnd.random() < 0.5
        checks = [rnd.choice([0.1, 0.24, None] if not calm else [0.1, 0.24]) for _ in range(4)]
        rows.append((f"s{rnd.randrange(12)}", i, rnd.random() < 0.8, rnd.random() < 0.2, rnd.choice([0, 0, 1]), *checks))
    want, locked = [], {}
    for s, i, ok, replay, others, *checks in rows:
        sound = ok and not replay and not others
        clean = sound and all((1.0 if c is None else c) <= most for c, most in zip(checks, (0.24, 0.6, 0.34, 0.44)))
        if locked.get(s):
            locked[s] = not clean
            want.append((s, i, locked[s], clean))
        else:
            locked[s] = replay
            want.append((s, i, replay, sound))
    df = spark.createDataFrame(rows, "session_id string, seq long, passed boolean, replay boolean, other_signals int, frame double, display double, paper double, heuristic double")
    got = bursts.replay_locked(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
