"""What a stream's fold holds of a key, and how often it calls the state store."""

import tracemalloc

import pandas as pd

from sealmark.streaming import jobs


class State:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_the_global_key_of_the_two_level_stream_is_held_compactly():
    n, part = 400_000, 10_000
    parts = (pd.DataFrame({"key": "all", "client": [f"client number {i % 16}" for i in range(k, k + part)], "call_id": range(k, k + part), "us": range(k * 1000, (k + part) * 1000, 1000)}) for k in range(0, n, part))
    p = jobs._TwoLevels(10**6, 3, 2, None)
    p.state = State()
    tracemalloc.start()
    outcomes = pd.concat([out["outcome"].value_counts() for out in p.handleInputRows(("all",), parts, None)]).groupby(level=0).sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert outcomes.sum() == n and outcomes["OK"] + outcomes.get("CLIENT", 0) < 3 * 401 and len(p.state.value[0]) == 3
    assert peak < 90 * n


def test_an_unchanged_state_costs_one_call():
    p = jobs._Fold("locked boolean", ["session_id", "seq", "locked"], ["seq"], (False,), lambda state, row: (state, (row.seq, state[0])), None)
    p.state = State()
    (out,) = p.handleInputRows(("a",), iter([pd.DataFrame({"session_id": "a", "seq": [3, 1]}), pd.DataFrame({"session_id": "a", "seq": [2]})]), None)
    assert out.values.tolist() == [["a", 1, False], ["a", 2, False], ["a", 3, False]] and p.state.calls == 1
