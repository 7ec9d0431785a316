"""g18 scores whole fields."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="needs the test tables")
def test_whole_names(spark):
    from sealmark.plans import face_queries

    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    want = {}
    for key, name in part.collect():
        read = name.translate(str.maketrans("oil", "011")) if key % 4 == 0 else name
        if key % 5:
            want[key] = round(1 - sum(a != b for a, b in zip(name, read)) / len(name), 6)
    got = {r.doc_id: r for r in face_queries.g18_char_accuracy(spark, str(SF)).collect()}
    assert len(got) == part.count() and {k: r.accuracy for k, r in got.items() if k in want} == pytest.approx(want, abs=2e-6)
    assert all(r.is_exact == (want[k] == 1) for k, r in got.items() if k in want) and min(want.values()) < 1
