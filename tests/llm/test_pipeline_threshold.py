"""The near-duplicates stage links from a similarity of 0.80 on."""

import pytest

from sealmark.llm.near_dup import bands_for

pytest.importorskip("public_tokenizers")


def test_copies_between_80_and_85(spark):
    import corpus_pipeline as cp

    rows, twins = [], []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(94)]  # 90 shingles; a changed word inside takes 5 of them
        for n, changed in ((0, ()), (1, (20, 60)), (2, (10, 30, 50, 70))):  # 80 of 100 and 70 of 110 in common
            rows.append((3 * k + n, " ".join(w + "q" * (i in changed) + str(n) * (i in changed) for i, w in enumerate(words)), "en", "s", 1))
        twins.append(3 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_duplicates_stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - set(twins)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_keep_recall(percent):
    assert (1 - (percent / 100) ** 6) ** bands_for(percent, 6) <= 1e-6 and bands_for(85, 6) == 32
