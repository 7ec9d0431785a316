import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sealmark.llm import lm_score


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def level(c):
    return math.frexp(c)[1]


def brute(rows, mu=lm_score.MU):
    train = [tokens(t) for i, t in rows if not lm_score.held_out(i)]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        t = tokens(text)
        p = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t}
        q = lambda a, b: (3 * 2.0 ** (level(pairs[a, b]) - 1) - 1) / 2 if pairs[a, b] else 0.0
        score = sum(math.log10((q(a, b) + mu * p[b]) / (c[a] + mu)) for a, b in zip([None, *t], t))
        out.append((i, zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p[w]) for w in t), score))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def close(got, want, score_slack):
    key = lambda r: str(r[:5]) + f"{r[5]:.6f}"
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=score_slack)


def test_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"W{i}ö" for i in range(60)])
    rows = [(i, " ".join(words[rng.zipf(1.4, rng.integers(0, 120)) % 60])) for i in range(80)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (7, rows[7][1]), (None, "W1ö w2ö"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("block", F.lit(1))
    # false positives of the filter may shift a score a little
    close(rows_of(lm_score.score(df)), brute(rows), 2e-2)


def test_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT_PAIRS", 50)
    rows = [(i, f"a b c{i % 7} d{i % 3} e{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    in_slices = rows_of(lm_score.score(df, slice_bytes=200, most_slices=10**6))
    close(in_slices, brute(rows), 2e-2)
    close(rows_of(lm_score.score(df, slice_bytes=200, most_slices=1)), in_slices, 1e-9)  # probed in place


def test_repeated_and_null_ids_over_many_partitions(spark, monkeypatch):
    """Blocks whose ids and codes are alike but whose words are not keep their own counts."""
    monkeypatch.setattr(lm_score, "SEGMENT_PAIRS", 4)
    rows = [(2, f"word{k}") for k in range(6)] + [(None, f"other{k % 3}") for k in range(6)] + [(2, "word0"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    for options in ({}, {"slice_bytes": 8}, {"slice_bytes": 8, "most_slices": 1}):
        close(rows_of(lm_score.score(df, **options)), brute(rows), 2e-2)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 500)
    rows = [(1, " ".join(f"w{i % 97}" for i in range(20_000))), (2, "w1 w2 w3"), (3, "w1 w2 w3"), (4, "")]
    close(rows_of(lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows), 2e-2)


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    low, counts = rng.integers(0, 1 << 40, 3000).astype(np.uint64), rng.integers(1, 300, 3000)
    levels = lm_score.level_of(counts)
    size = -(-int(levels.sum()) * lm_score.BITS_PER_ENTRY // 64) * 64
    bits = np.zeros(size, bool)
    for k in range(1, levels.max() + 1):
        for at in lm_score._bits(low[levels >= k], k, np.array(size)):
            bits[at.astype(np.int64)] = True
    part = lm_score.FilterSlice(1, 0, np.array([size // 8]), np.packbits(bits, bitorder="little").tobytes())
    _, got = part.levels(low)
    assert (got >= levels).all() and (got == levels).mean() > 0.98
    _, other = part.levels(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    assert (other == 0).mean() > 0.98
