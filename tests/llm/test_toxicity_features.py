"""Every feature far enough from 0 is kept, and the solver ends at the least loss."""

import numpy as np
from pyspark.sql import functions as F

from sealmark.llm import toxicity


def test_no_cap_on_features(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 5, raising=False)
    docs = [(i, ("zotrash quvile " if i % 3 == 0 else "meadow bright ") + f"w{i % 17}", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert len(model.features) > 30 and toxicity.MAX_FIT_ROWS == 20_000
    assert toxicity.score(df, model).join(df, "doc_id").where(F.col("predicted") != F.col("toxic")).isEmpty()


def test_solver_reaches_the_optimum(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_ENTRIES", 50)
    rng = np.random.default_rng(6)
    x = rng.random((200, 12)) < 0.3
    x[7] = False
    y = (rng.random(200) < 1 / (1 + np.exp(1 - 2 * x[:, 0] + 1.5 * x[:, 1]))).astype(int)
    ratios = rng.normal(size=12)
    coded = spark.createDataFrame([(int(t), np.flatnonzero(r).tolist()) for r, t in zip(x, y)], "toxic int, hits array<int>").repartition(3)
    w, b = toxicity._solve(coded, ratios, int(y.sum()), int(200 - y.sum()), 1e-2)
    off = 1 / (1 + np.exp(-(x @ (w * ratios) + b))) - y
    assert np.abs((x * off[:, None]).mean(0) * ratios + 1e-2 * w).max() < 1e-4 and abs(off.mean()) < 1e-4
