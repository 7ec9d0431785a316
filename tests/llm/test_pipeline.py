"""The corpus pipeline against plain versions of its stages, on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")


def corpus():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(150):
        text = "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(25, 60))) for _ in range(3))
        rows.append([i, text + ("\nAll rights reserved everywhere." if i % 2 else ""), "en", f"s{i % 13}", 0])
    rows += [[200 + i, rows[i][1], "en", f"s{(i + 5) % 13}", 0] for i in range(20)]
    rows += [[300 + i, re.sub(r"w\d+$", "changed", rows[i][1].split("\nAll")[0]), "en", f"s{i % 13}", 0] for i in range(10)]
    rows += [[400, "too short", "en", "s0", 0], [401, None, "en", "s1", 0], [402, "", None, None, None], [403, " ".join(["same words here"] * 40), "en", "s2", 0]]
    return [tuple(r[:4]) + (None if r[1] is None else len(r[1]),) for r in rows]


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from sealmark.llm import quality

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    now = docs
    for name, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path))
        out[name] = now.collect()
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
            now = spark.createDataFrame(out[name], docs.schema)
    by = lambda name: {r.doc_id: r for r in out[name]}
    assert set(by("quality rules")) == {r[0] for r in rows if r[0] < 400}
    # every line of the corpus survives line dedup, boilerplate in its first document alone
    lines = lambda rs: Counter(x for r in rs for x in (r.text or "").split("\n"))
    before, after = lines(out["quality rules"]), lines(out["line dedup"])
    assert after["All rights reserved everywhere."] == 1 and set(after) == set(before)
    assert all(r.n_chars == len(r.text) for r in out["line dedup"])
    kept = set(by("near duplicates"))
    assert set(range(150)) <= kept and not kept & set(range(200, 220))
    size = lambda r: len((r.text or "").split())
    drawn, sizes = Counter(), defaultdict(int)
    for r in out["near duplicates"]:
        sizes[r.source] += size(r)
    for r in out["source mixing"]:
        drawn[r.source] += size(r)
    assert sum(drawn.values()) <= 1.5 * sum(sizes.values()) and all(drawn[s] <= 2 * sizes[s] for s in sizes)
    fills = defaultdict(int)
    for r in out["best-fit packing"]:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    assert Counter(r.doc_id for r in out["best-fit packing"] if r.piece == 0) == Counter(r.doc_id for r in out["source mixing"])
    assert quality.POLICIES and cp.run(spark, str(tmp_path)).count() == len(out["best-fit packing"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_stages(rows):
    """The rows after quality rules, line dedup and near duplicates, by plain versions."""
    from test_native import plain_dedup, plain_measures
    from test_near_dup import brute

    def good(t):
        m = plain_measures(t)
        n = m["n_words"]
        return not (
            n < 50 or 100 * m["n_repeat_words"] > 50 * n or 10 * m["n_symbols"] > 3 * n or (m["n_dup_lines"] >= 3 and 100 * m["n_dup_lines"] > 30 * m["n_lines"])
            or m["word_chars"] < 2 * n or m["word_chars"] > 14 * n
        )

    first = [r for r in rows if good(r[1])]
    second = []
    for r, (_, text, removed) in zip(first, plain_dedup([(r[0], r[1], r[3]) for r in first], 10)):
        if not removed or text.split():
            second.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    parts = brute([(r[0], r[1]) for r in second], percent=80)
    return first, second, [r for r in second if parts[r[0]][2]]


def test_against_plain_versions(spark):
    import zlib

    import corpus_pipeline as cp
    import duckdb
    import numpy as np
    import pyarrow as pa
    from sealmark.llm import oracles
    from test_packing import plain

    rows = corpus()
    now = spark.createDataFrame(rows, COLUMNS)
    for (name, stage), want in zip(cp.STAGES, plain_stages(rows)):
        got = sorted((tuple(r) for r in stage(spark, now, "").collect()), key=str)
        assert got == sorted(want, key=str), name
        now = spark.createDataFrame(got, COLUMNS)
    documents = pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*got))))  # noqa: F841 (read by name)
    taken = Counter()
    for doc_id, size, n in duckdb.sql("SELECT doc_id, size, taken FROM (" + oracles.MIX + ")").fetchall():
        taken[doc_id] = n // size if size else 0
    mixed = cp.mixing_stage(spark, now, "").collect()
    texts = {r[0]: r for r in got}
    assert Counter(r.doc_id for r in mixed) == +taken and all(tuple(r) == texts[r.doc_id] for r in mixed)
    want = Counter()
    for r in mixed:
        ids = [*plain(r.text), 0]
        want.update((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
    packed = cp.packing_stage(spark, spark.createDataFrame(mixed, COLUMNS), "").collect()
    assert Counter(tuple(r)[:5] for r in packed) == want


def test_odd_rows(spark, tmp_path):
    """Null ids, sources and texts, repeated rows and ids, ties, a very long text; then no rows at all."""
    import corpus_pipeline as cp

    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    a, b, long = text(80), text(70), "\n".join(text(50) for _ in range(1500))
    rows = [(1, a, "en", "s0", len(a)), (1, a, "en", "s0", len(a)), (1, b, "en", None, len(b)), (2, a, None, None, None), (None, a, "en", "s0", len(a)), (None, None, None, None, None)]
    rows += [(3, long, "en", "s1", len(long)), (4, "", "en", "s1", 0), (5, text(60), "en", "s1", 9), (6, text(60), "en", "s2", 9)]
    docs = spark.createDataFrame(rows, COLUMNS)
    ids = []
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), COLUMNS)
        ids.append(sorted((r.doc_id or 0 for r in docs.select("doc_id").collect())))
    assert ids[0] == ids[1] == [0, 1, 1, 1, 2, 3, 5, 6] and ids[2] == [0, 1, 1, 1, 3, 5, 6] and set(ids[3]) <= set(ids[2])
    packed = cp.STAGES[4][1](spark, docs, "").collect()
    assert Counter(r.doc_id or 0 for r in packed if r.piece == 0) == Counter(ids[3])
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
