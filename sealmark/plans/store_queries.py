"""Queries over attempts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions.scalars import blind_index
from sealmark.operators import audit, datasets, stores
from sealmark.plans.bindings import bind, oracle, table

AS_OF = "2024-01-30"


def _attempts(spark, sf):
    return stores.attempt_rows(stores.attempt_upsert(bind(spark, sf, "steps")))


ATTEMPTS = """--with attempts AS (SELECT session_id, arg_max(user_id, (ts, seq)) AS user_id, arg_max(decision, (ts, seq)) AS decision,
 arg_max(client_ip, (ts, seq)) FILTER (client_ip IS NOT NULL) AS client_ip, count(*) AS step_count, min(ts) AS created_at, max(ts) AS updated_at FROM steps GROUP BY session_id)
"""


def e1_attempt_upsert(spark, sf):
    return _attempts(spark, sf)


def e2_attempt_page(spark, sf):
    return stores.attempt_page(_attempts(spark, sf), decision="rejected", limit=50, offset=20)


def e3_decision_summary(spark, sf):
    return stores.decision_summary(_attempts(spark, sf))


def e4_attempt_retention(spark, sf):
    return stores.purge_count(_attempts(spark, sf), F.col("updated_at"), F.lit(AS_OF).cast("timestamp_ntz"), 20)


def e5_profile_retention(spark, sf):
    kept = stores.retained(bind(spark, sf, "profiles"), F.coalesce("last_login_at", "enrolled_at"), F.lit("2001-01-01").cast("date"), 365)
    return kept.groupBy("nationality").agg(F.count("*").alias("kept"))


def _user_sessions(spark, sf):
    return bind(spark, sf, "steps").groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def e6_session_expiry(spark, sf):
    gone = stores.expired_sessions(_user_sessions(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"), "3 DAYS", "10 DAYS")
    return stores.without(bind(spark, sf, "steps"), gone, "session_id").groupBy("session_id").agg(F.count("*").alias("steps_left"))


def _requests(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), (F.col("o_orderstatus") == "F").alias("verified")).where("o_orderkey % 11 = 0")


def e7_erasure(spark, sf):
    kept, erased = stores.erase(bind(spark, sf, "profiles"), _requests(spark, sf))
    return kept.agg(F.count("*").alias("kept")).crossJoin(erased)


def e8_active_profiles(spark, sf):
    return bind(spark, sf, "profiles").where("active").select("face_id", "user_id", "nationality")


INDEX_KEY = b"index-key"


def e9_enrolment(spark, sf):
    """Every second customer is enrolled, by the keyed index of its number; the others come in a batch, and each tenth anew with another number."""
    people = bind(spark, sf, "profiles")
    row = people.select("face_id", "user_id", "passport_number", F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"), "active", "c_custkey", "enrolled_at", "consent_version")
    stored = row.where("c_custkey % 2 = 0").withColumn("passport_index", blind_index(F.col("passport_number"), INDEX_KEY)).drop("c_custkey", "passport_number")
    k = F.col("c_custkey")
    batch = row.where("c_custkey % 2 = 1 or c_custkey % 10 = 0").select(
        k.alias("seq"), "user_id", F.when(k % 10 == 0, F.concat("passport_number", F.lit("X"))).when(k % 4 != 1, F.col("passport_number")).alias("passport_number"), F.when(k % 4 == 1, F.col("passport_number")).alias("id_number"),
        "session_id", F.when(k % 13 == 0, "pending").otherwise("passed").alias("decision"), (k % 17 != 0).alias("has_template"), F.lit("2024-01-30").cast("timestamp").alias("enrolled_at"),
    )
    return stores.enrol(stored, batch, INDEX_KEY, "v9").drop("enrolled_at", "consented_at")


def e10_shared_documents(spark, sf):
    return stores.shared_documents(bind(spark, sf, "profiles"))


def _matches(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("face_id"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).cast("date").alias("at"))


def e11_mark_login(spark, sf):
    return stores.mark_logins(bind(spark, sf, "profiles"), _matches(spark, sf)).select("face_id", "last_login_at")


def e12_admin_overview(spark, sf):
    """Sixteen chains of audit entries, one of which an entry was taken out of."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 16).alias("chain"), F.concat_ws("|", "event_id", "event_type", "props").alias("canonical"))
    log = audit.append(e).where("seq <> 9001")
    return stores.admin_overview(_attempts(spark, sf), bind(spark, sf, "profiles"), log, profile_days=365, attempt_days=90)


def e13_subject_export(spark, sf):
    """One request per matched face; every fifth is of a burst with two faces, every seventh matches nobody."""
    k = F.substring("face_id", 2, 20).cast("long")
    asks = _matches(spark, sf).groupBy("face_id").agg(F.max("at").alias("at")).select(
        F.concat("face_id", F.lit("@"), F.col("at").cast("string")).alias("request_id"), F.when(k % 5 == 0, F.array(F.lit("MULTIPLE_FACES"))).alias("reasons"), F.when(k % 7 != 0, F.col("face_id")).alias("face_id"), (k % 1000 / 1000.0).alias("score"),
    )
    out = stores.subject_export(asks, bind(spark, sf, "profiles"))
    kept = ("face_id", "user_id", "full_name", "passport_number", "nationality", "enrolled_at", "last_login_at", "consent_version")
    return out.select("request_id", "verified", F.concat_ws("|", "reason_codes").alias("reason_codes"), F.round("match_score", 2).alias("match_score"), *(F.col(f"profile.{c}").alias(c) for c in kept))


def e14_stratified_cap(spark, sf):
    return stores.capped(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 5)


def e15_interleave(spark, sf):
    return stores.interleaved(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


def e16_resume(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return stores.resumed(docs, docs.where("doc_id % 3 = 0"), "doc_id", F.least(F.floor(F.col("n_chars") / 500) + 1, F.lit(8)), 400, ["doc_id"])


def selfie_paths(spark, sf):
    """A path for every page: folders of selfies, known and unknown, files of several sets and kinds."""
    k = F.col("page_id")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    folder = pick(("live_user_provided", "spoof_screen_replay", "spoof_print_paper", "spoof_mask_cutout", "spoof_unknown", "other"), k)
    name = F.concat(pick(("axon_display_replay_", "mine_", "axon_print_paper", "axon_large_", "Axon_large_"), F.floor(k / 6)), k.cast("string"), pick((".jpg", ".PNG", ".txt", ".bmp", ".webp", ".tiff", ""), F.floor(k / 30)))
    return table(spark, sf, "pages").select("page_id", F.concat(folder, F.when(k % 11 == 0, "/sub").otherwise(""), F.lit("/"), name).alias("relative"))


def e17_source_labels(spark, sf):
    return datasets.selfie_labels(selfie_paths(spark, sf))


def e2_next_page(spark, sf):
    """The page after the one of e2, found by that page's last row."""
    rows = _attempts(spark, sf)
    last = stores.attempt_page(rows, decision="rejected", limit=50, offset=20).select("updated_at", "session_id").collect()
    return stores.attempt_page_after(rows, tuple(last[-1]) if last else None, decision="rejected", limit=50)


QUERIES = [e1_attempt_upsert, e2_attempt_page, e2_next_page, e3_decision_summary, e4_attempt_retention, e5_profile_retention, e6_session_expiry, e7_erasure, e8_active_profiles, e9_enrolment, e10_shared_documents,
           e11_mark_login, e12_admin_overview, e13_subject_export, e14_stratified_cap, e15_interleave, e16_resume, e17_source_labels]

MASKED = """CASE WHEN {0} IS NULL OR {0} = '' THEN {0} WHEN length(trim({0})) <= 4 THEN repeat('•', length(trim({0})))
 ELSE substr(trim({0}), 1, 2) || repeat('•', length(trim({0})) - 4) || right(trim({0}), 2) END"""
MATCHES = "(SELECT 'f' || o_custkey AS face_id, max(CAST(o_orderdate AS DATE) + 1) AS at FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)"

SQL = {
    "e1_attempt_upsert": oracle(ATTEMPTS + "SELECT * FROM attempts", "steps"),
    "e2_attempt_page": oracle(ATTEMPTS + "SELECT * FROM attempts WHERE decision = 'rejected' ORDER BY updated_at DESC, session_id LIMIT 50 OFFSET 20", "steps"),
    "e2_next_page": oracle(ATTEMPTS + "SELECT * FROM attempts WHERE decision = 'rejected' ORDER BY updated_at DESC, session_id LIMIT 50 OFFSET 70", "steps"),
    "e3_decision_summary": oracle(ATTEMPTS + "SELECT count(*) FILTER (decision = 'passed') AS passed, count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision = 'rejected') AS rejected, count(*) AS total FROM attempts", "steps"),
    "e4_attempt_retention": oracle(ATTEMPTS + f"SELECT count(*) FILTER (updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS purged, count(*) FILTER (updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS kept FROM attempts", "steps"),
    "e5_profile_retention": oracle("SELECT nationality, count(*) AS kept FROM profiles WHERE coalesce(last_login_at, enrolled_at) >= DATE '2001-01-01' - 365 GROUP BY nationality", "profiles"),
    "e6_session_expiry": oracle(f"SELECT session_id, count(*) AS steps_left FROM steps GROUP BY session_id HAVING max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND min(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY", "steps"),
    "e7_erasure": oracle("--with gone AS (SELECT DISTINCT 'u' || o_custkey AS user_id FROM orders WHERE o_orderkey % 11 = 0 AND o_orderstatus = 'F') SELECT count(*) FILTER (g.user_id IS NULL) AS kept, count(g.user_id) AS erased FROM profiles p LEFT JOIN gone g ON g.user_id = p.user_id", "profiles"),
    "e8_active_profiles": oracle("SELECT face_id, user_id, nationality FROM profiles WHERE active", "profiles"),
    "e10_shared_documents": oracle("SELECT passport_number, count(DISTINCT user_id) AS n_members, min(user_id) AS first_member FROM profiles GROUP BY passport_number HAVING count(DISTINCT user_id) > 1", "profiles"),
    "e11_mark_login": oracle(f"SELECT p.face_id, coalesce(m.at, p.last_login_at) AS last_login_at FROM profiles p LEFT JOIN {MATCHES} m ON m.face_id = p.face_id", "profiles"),
    "e12_admin_overview": oracle(ATTEMPTS + "SELECT (SELECT count(*) FROM attempts WHERE decision = 'passed') AS passed, (SELECT count(*) FROM attempts WHERE decision = 'pending') AS pending, (SELECT count(*) FROM attempts WHERE decision = 'rejected') AS rejected, (SELECT count(*) FROM attempts) AS total, (SELECT count(*) FROM profiles WHERE active) AS enrolled_face_ids, (SELECT count(*) = 0 FROM events WHERE event_id = 9001 AND (SELECT max(event_id) FROM events) >= 9017) AS audit_chain_ok, (SELECT count(*) FROM events WHERE event_id <> 9001) AS audit_entries, true AS audit_log_enabled, 365 AS profile_retention_days, 90 AS attempt_retention_days", "steps", "profiles"),
    "e13_subject_export": oracle(f"""--with q AS (SELECT m.face_id, m.at AS asked, substr(m.face_id, 2)::BIGINT AS k FROM {MATCHES} m),
 r AS (SELECT q.*, q.k % 5 = 0 AS crowd, p.user_id IS NOT NULL AND q.k % 5 <> 0 AND q.k % 7 <> 0 AS ok, p.* EXCLUDE (face_id) FROM q LEFT JOIN profiles p ON p.face_id = q.face_id AND p.active)
 SELECT 'f' || k || '@' || asked AS request_id, ok AS verified, CASE WHEN crowd THEN 'MULTIPLE_FACES' WHEN NOT ok THEN 'NO_MATCH' ELSE '' END AS reason_codes, CASE WHEN crowd THEN 0 ELSE round(k % 1000 / 1000.0::DOUBLE, 2) END::DOUBLE AS match_score,
 {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in ('face_id', 'user_id', 'full_name', 'passport_number', 'nationality', 'enrolled_at', 'last_login_at', 'consent_version'))} FROM r""", "profiles"),
    "e14_stratified_cap": "SELECT doc_id, source, CAST(rank AS INT) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5",
    "e15_interleave": "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS round FROM documents",
    "e16_resume": """WITH l AS (SELECT doc_id, n_chars, least(n_chars // 500 + 1, 8) AS wanted FROM documents WHERE doc_id % 3 <> 0),
 b AS (SELECT *, coalesce(sum(wanted) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
 SELECT doc_id, n_chars, CAST(wanted AS BIGINT) AS wanted, CAST(least(wanted, 400 - before) AS BIGINT) AS take FROM b WHERE before < 400""",
    # what each folder and each beginning of a name stands for
    "e17_source_labels": """WITH p AS (SELECT page_id, ['live_user_provided', 'spoof_screen_replay', 'spoof_print_paper', 'spoof_mask_cutout', 'spoof_unknown', 'other'][page_id % 6 + 1] AS folder, page_id // 6 % 5 AS n, page_id // 30 % 7 AS e FROM pages)
SELECT page_id, folder || CASE WHEN page_id % 11 = 0 THEN '/sub' ELSE '' END || '/' || ['axon_display_replay_', 'mine_', 'axon_print_paper', 'axon_large_', 'Axon_large_'][n + 1] || page_id || ['.jpg', '.PNG', '.txt', '.bmp', '.webp', '.tiff', ''][e + 1] AS relative,
 CASE folder WHEN 'live_user_provided' THEN 'live' ELSE 'spoof' END AS expected,
 CASE WHEN n = 0 THEN 'screen_replay' WHEN n = 2 THEN 'print_paper_or_cardboard_mask' ELSE MAP {'live_user_provided': 'live_selfie', 'spoof_screen_replay': 'screen_replay', 'spoof_print_paper': 'print_paper_or_cardboard_mask', 'spoof_mask_cutout': 'mask_or_cutout', 'spoof_unknown': 'unknown_spoof'}[folder] END AS attack_type,
 CASE n WHEN 0 THEN 'AxonData/Display_replay_attacks' WHEN 2 THEN 'AxonData/print-cardboard-mask-face-spoofing' WHEN 3 THEN 'AxonData/face-anti-spoofing-dataset' ELSE 'user_provided' END AS source FROM p WHERE folder <> 'other' AND e NOT IN (2, 5, 6)""",
}
