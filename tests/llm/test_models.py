"""Embedding near-duplicates and toxicity."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealmark.llm import embedding_dup, toxicity


def brute(rows, threshold=0.93):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            ok.append(k)
    at, links = {i: i for i, _, _ in rows if i is not None}, [0] * len(rows)

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            (i, v, x), (j, w, y) = rows[a], rows[b]
            if x == y and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(i), find(j)
                at[max(p, q)] = min(p, q)
    return sorted(((i, links[k], None if i is None else find(i), True if i is None else find(i) == i) for k, (i, _, _) in enumerate(rows)), key=str)


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dup, "TILE", 24)
    monkeypatch.setattr(embedding_dup, "TILE_BYTES", 1)  # 256 at least
    monkeypatch.setattr(embedding_dup, "AXES_ROWS", 50)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(12):
            base = rng.standard_normal(20)
            for _ in range(rng.integers(1, 9)):
                v = (base + rng.standard_normal(20) * rng.choice([0, 0.1, 0.22, 0.3])) * rng.choice([1.0, 3.0])
                rows.append((n := n + 1, [float(x) for x in v.astype(np.float32)], label))
    rows += [(500, [1.0] * 3, 1), (501, [2.0] * 3, 1), (502, [0.0] * 20, 1), (503, None, 1), (504, [1.0, None], 1), (505, [float("nan")] * 20, 1), (506, [], 1), (507, rows[0][1], None), (508, [float("inf")] * 20, 1), (None, rows[0][1], 1)]
    rng.shuffle(rows)
    rows = [(None if r[0] is None else int(r[0]), None if r[1] is None else list(r[1]), None if r[2] is None else int(r[2])) for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"n": F.lit("x"), "v": F.lit(1), "n_links": F.lit(2)})
    got = sorted((tuple(r) for r in embedding_dup.embedding_near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert embedding_dup.embedding_near_duplicates(df.limit(0)).collect() == []


def test_embedding_links_over_many_tiles(spark, monkeypatch):
    """One label with strips, tiles, a cell that is dealt to parts, chains of links through tiles; floats and few dimensions."""
    monkeypatch.setattr(embedding_dup, "TILE_BYTES", 1)
    monkeypatch.setattr(embedding_dup, "BLOCK", 100)
    rng = np.random.default_rng(9)
    for d, kind in ((2, "float"), (6, "double"), (1, "float")):
        base = rng.standard_normal((60, d)) if d > 1 else np.ones((1, 1))
        v = (base[rng.integers(len(base), size=900)] + 0.15 * rng.standard_normal((900, d)) * (d > 1) + (rng.random((900, 1)) * (d == 1))).astype(np.float32)
        rows = [(i, [float(x) for x in r], "a") for i, r in enumerate(v)] + [(2000, [1.0] * d, "b")]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.embedding_near_duplicates(df).collect()}
        u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
        links = u @ u.T >= 0.93
        np.fill_diagonal(links, False)
        root = np.arange(900)
        while True:
            new = np.minimum(root, np.where(links, root[None, :], 900).min(1))
            if (new == root).all():
                break
            root = new
        assert got.pop(2000) == (0, 2000)
        assert got == {i: (int(links[i].sum()), int(root[i])) for i in range(900)}


def test_early_stop_loses_nothing():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((80, 64)) + 2 * rng.standard_normal(64)
    b = np.concatenate((a[:40] + 0.3 * rng.standard_normal((40, 64)), rng.standard_normal((40, 64))))
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    for t in (0.5, 0.9, 0.97):
        assert (embedding_dup.linked(a, b, axes, t) == (u @ w.T >= t)).all()


def test_toxicity_against_plain_version(spark):
    """Ratios from plain n-gram sets, weights by plain gradient steps, on a small sample."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(160):
        words = [str(w) for w in rng.choice(["ab", "Ca ", "dé", "e\tf", "gh"], rng.integers(1, 6))]
        toxic = int(rng.random() < 0.4)
        rows.append((i, " ".join([*words, "zot"] if toxic and rng.random() < 0.9 else words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), penalty=1e-2)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def grams(text):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", f" {text.lower()} ")
        return {t[k : k + n] for n in (3, 4, 5, 6) for k in range(len(t) - n + 1)}

    pos, neg = (Counter(g for r in train if r[2] == k for g in grams(r[1])) for k in (1, 0))
    n_pos, n_neg = sum(r[2] for r in train), sum(1 - r[2] for r in train)
    ratio = {g: np.log((pos[g] + 1) / (n_pos + 2)) - np.log((neg[g] + 1) / (n_neg + 2)) for g in pos | neg}
    names = sorted(g for g, x in ratio.items() if abs(x) / np.sqrt(1 / (pos[g] + 1) + 1 / (neg[g] + 1)) >= toxicity.LEAST_Z)
    assert len(names) == len(model.features) > 3
    value = lambda text: np.array([ratio[g] * (g in grams(text)) for g in names])
    x, y = np.array([value(r[1]) for r in train]), np.array([r[2] for r in train])
    w, b = np.zeros(len(names)), 0.0
    for _ in range(30_000):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.05 * (x.T @ off / len(y) + 1e-2 * w), b - 0.05 * off.mean()
    for r in toxicity.score(df, model).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-(value(rows[r.doc_id][1]) @ w + b))), abs=2e-3)


def test_toxicity_of_a_very_long_text(spark):
    docs = [(i, ("zotrash " if i % 3 == 0 else "meadow ") * 30, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    long = spark.createDataFrame([(1, "river " * 400_000 + "zotrash zotrash"), (2, "meadow " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(long, model).collect()}
    assert got[1].score > got[2].score and got[2].predicted == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(1)
    vocab = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("nt", "rl", "mm", "sk")]
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocab, rng.integers(8, 80)))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for w in rng.choice(["zotrash", "quvile"], 2):
                words.insert(rng.integers(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(2000, None), (2001, ""), (None, "zotrash quvile"), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"toxic": F.lit(9), "score": F.lit("x"), "fit_id": F.lit(1)})
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (4000, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(df.drop("toxic", "fit_id"), lab)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert {bool(r.held_out) for r in rows if r.doc_id == 3} and sum(r.held_out for r in rows) > 150
    right = np.mean([r.predicted == labels[r.doc_id][1] for r in held])
    assert right > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[2000].score == by[2001].score and 0 <= by[2000].score < 0.3 and by[None].predicted == 1
    assert all((r.score >= 0.3) == bool(r.predicted) for r in rows)
    assert toxicity.score(df.limit(0), model).collect() == []
    empty = toxicity.fit(df.drop("toxic", "fit_id"), lab.limit(0))
    assert toxicity.score(df, empty).first().score == pytest.approx(0.5)
