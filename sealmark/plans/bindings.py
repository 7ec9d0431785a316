"""Verification tables derived from the star-schema and event tables; one text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Two decimals of a pseudo-random share that varies with the event.
def _cue(a: int, m: int = 101) -> str:
    return f"CAST((event_id * {a}) % {m} AS DOUBLE) / 100"


TEXTS = {
    "steps": """
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, CAST(user_id AS STRING) AS user_id, event_id AS seq, ts, event_type,
  CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS decision, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE '10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) END AS client_ip FROM {events}""",
    "profiles": """
SELECT 'f' || CAST(c_custkey AS STRING) AS face_id, 'u' || CAST(c_custkey AS STRING) AS user_id, c_custkey, c_name AS full_name, c_custkey % 7 <> 0 AS active,
  'P' || lpad(CAST(c_custkey % (SELECT CAST((count(*) * 9 - (count(*) * 9) % 10) / 10 AS BIGINT) FROM {customer}) AS STRING), 8, '0') AS passport_number,
  coalesce(CAST(o.first_order AS DATE), DATE '1995-01-01') AS enrolled_at, CAST(o.last_order AS DATE) AS last_login_at, n_name AS nationality,
  'v' || CAST(c_custkey % 3 AS STRING) AS consent_version FROM {customer} c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
  LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "signals": """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS pos,
  'CODE_' || CAST(l_partkey % 19 AS STRING) AS code, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, round(l_discount * 10, 2) AS score FROM {lineitem}""",
    "findings": """
SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'document_liveness' WHEN 1 THEN 'tamper' ELSE 'general_fraud' END AS family,
  CASE l_suppkey % 4 WHEN 0 THEN 'heuristic_print_copy_v1' WHEN 1 THEN 'heuristic_portrait_substitution_v1' ELSE 'other' END AS model_id,
  round(l_discount * 10, 2) AS score, round(l_tax * 12, 2) AS confidence, CASE l_linestatus WHEN 'O' THEN 'available' ELSE 'unavailable' END AS status FROM {lineitem}""",
    "metrics": """
SELECT o_orderkey AS doc_id, (o_orderkey * 7919) % 1200000 AS pixels, CAST((o_orderkey * 31) % 256 AS DOUBLE) AS brightness, CAST((o_orderkey * 17) % 64 AS DOUBLE) AS contrast,
  CAST((o_orderkey * 13) % 160 AS DOUBLE) / 10 AS sharpness, CAST((o_orderkey * 11) % 30 AS DOUBLE) / 100 AS glare_ratio,
  CAST((o_orderkey * 23) % 100 AS DOUBLE) / 100 AS edge_density, CAST((o_orderkey * 29) % 300 AS DOUBLE) / 100 AS aspect, CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS border_score,
  CAST((o_orderkey * 41) % 101 AS DOUBLE) / 100 AS ela_score, CAST((o_orderkey * 43) % 101 AS DOUBLE) / 100 AS blockiness, CAST((o_orderkey * 47) % 101 AS DOUBLE) / 100 AS saturation,
  CASE o_orderkey % 5 WHEN 0 THEN 'scan.TIFF' WHEN 1 THEN 'a.JPG' WHEN 2 THEN 'b.png' WHEN 3 THEN 'c.webp' ELSE 'd.jpeg' END AS filename FROM {orders}""",
    "frames": f"""
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS idx,
  event_id, {_cue(7)} AS quality, {_cue(11)} AS face_match, {_cue(13)} AS risk, {_cue(17, 71)} AS screen_frame, {_cue(19, 67)} AS display_surface, {_cue(23, 61)} AS paper_photo,
  {_cue(29, 90)} AS held_phone, {_cue(31)} AS model_risk, {_cue(37, 53)} AS heuristic_risk, CAST((event_id * 41) % 256 AS DOUBLE) AS brightness, {_cue(43, 23)} AS glare_ratio,
  {_cue(47, 60)} AS face_width, 0.75 + CAST((event_id * 53) % 25 AS DOUBLE) / 100 AS face_confidence, CAST(CASE WHEN event_id % 29 = 0 THEN 2 WHEN event_id % 31 = 0 THEN 0 ELSE 1 END AS INT) AS face_count,
  event_id % 31 <> 0 AS has_face, {_cue(59, 83)} AS moire, {_cue(61, 67)} AS saturation, CAST((event_id * 67) % 60 AS DOUBLE) AS contrast, CAST((event_id * 71) % 90 AS DOUBLE) / 10 AS sharpness,
  {_cue(73, 31)} AS skin_ratio, (event_id * 7919) % 900000 AS pixels FROM {{events}}""",
    "embedded": """
SELECT 'f' || lpad(CAST(vec_id AS STRING), 8, '0') AS face_id, vec_id, label, vec_id % 10 = 0 AS is_probe, vec_id % 7 <> 3 AS active, embedding FROM {embeddings}""",
    "contacts": """
SELECT CAST(user_id AS STRING) AS session_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'issue' WHEN 'click' THEN 'confirm' END AS kind,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS STRING) AS code FROM {events} WHERE event_type IN ('signup', 'click')""",
    "calls": "SELECT CAST(user_id AS STRING) AS key, event_id AS call_id, ts, '10.0.0.' || CAST(user_id % 16 AS STRING) AS client_ip FROM {events}",
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", TEXTS[name]))}
    return spark.sql(TEXTS[name], **tables)


def oracle(body: str, *names: str) -> str:
    """body with the named tables in front of it."""
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", TEXTS[n]) for n in names}
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in plain.items()) + (", " if body.lstrip().startswith("--with") else " ") + body.replace("--with", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
