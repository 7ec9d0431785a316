"""Registered queries against DuckDB on the smallest tables, and the library without its training-data part."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "a4_table_reader", "a5_result_rows", "a6_summary", "a7_manifest_upsert", "a8_import_profiles", "b18_name_tokens", "c6_portrait", "d9_login_burst", "d10_gestures", "d11_face_actions", "g3_face_login", "g7_impostor_pairs", "g18_char_accuracy",
    "k2_candidate_lines", "k4_repaired_lines", "k5_names", "k8_mrz_outcome", "k9_truth_fields", "k10_id_cards", "s_f1_limit_stream", "s_f2_two_level_stream", "s_f4_code_stream", "s_d7_replay_stream", "s_e1_attempt_stream", "s_e6_session_stream", "b4_split_name", "b7_blind_index", "b16_signal_dedupe", "b20_lighting", "c7_document_risk", "c11_selfie_frames", "c12_decision", "d5_burst_verdict", "d6_active_liveness", "d7_replay_lock", "e1_attempt_upsert",
    "e13_subject_export", "e16_resume", "f2_two_level_limit", "f4_code_outcomes", "g2_identify", "g10_equal_error", "g17_field_accuracy", "h2_append", "h3_verify", "k3_td3_fields",
    "a1_folder_listing", "b14_document_type", "b15_sample_frames", "c6_model_adapters", "e12_admin_overview", "e17_source_labels", "g16_genuine_rates", "g19_negative_control", "w3_passport_reports", "s_e6_late_rows",
)
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="needs the test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(spark, name):
    from sealmark.plans import registry

    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    text = lambda rows: sorted([plain(v) for v in r] for r in rows)
    assert text(got) == text(want) and got


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first().total > 0


def test_library_without_training_data_part(spark, tmp_path):
    """A copy without those folders imports, has all other queries, and runs them."""
    copy = tmp_path / "copy"
    gone = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, copy, ignore=gone)
    assert not list(copy.rglob("llm")) and (copy / "sealmark" / "plans").is_dir()
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
from sealmark.plans import registry
assert set(e.queries()) == set(registry.queries()) and len(e.queries()) > 100 and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
print(e.entry(spark).first().total > 0, e.queries()["h3_verify"](spark, "{SF}").count(), e.queries()["e9_enrolment"](spark, "{SF}").count() > 0)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert said.stdout.split() == ["True", "16", "True"], said.stderr
