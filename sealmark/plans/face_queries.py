"""Queries over face matching and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions.scalars import mask_document_number
from sealmark.operators import bursts, matching, metrics
from sealmark.plans.bindings import bind, oracle, table
from sealmark.plans.burst_queries import login_sql


def _people(spark, sf):
    """Embeddings with the smallest id of a label as its reference."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("identity"), "embedding")
    first = rows.groupBy("identity").agg(F.min("vec_id").alias("ref"))
    rows = rows.join(F.broadcast(first), "identity")  # one row per identity
    return rows.where("vec_id = ref").drop("ref"), rows.where("vec_id <> ref").drop("ref")


def _pairs(spark, sf):
    refs, selfies = _people(spark, sf)
    return matching.genuine_pairs(refs, selfies).unionByName(matching.impostor_pairs(refs, selfies))


def g1_match_scores(spark, sf):
    return matching.genuine_pairs(*_people(spark, sf)).select("ref_id", "selfie_id", "score")


def _identified(spark, sf):
    e = bind(spark, sf, "embedded")
    return matching.identify(e.where("is_probe").select(F.col("vec_id").alias("probe_id"), "embedding"), e.where("not is_probe"), threshold=0.6)


def g2_identify(spark, sf):
    return _identified(spark, sf)


def g3_face_login(spark, sf):
    login = bursts.login_bursts(bind(spark, sf, "frames").withColumn("embedding_id", F.col("event_id") % 50 * 10))
    found = _identified(spark, sf).select(F.col("probe_id").alias("embedding_id"), "face_id", "score")
    out = login.join(found, "embedding_id", "left")
    free = F.size("reasons") == 0
    reasons = F.when(free & F.col("face_id").isNull(), F.array(F.lit("FACE_LOGIN_NO_MATCH"))).otherwise(F.col("reasons"))
    return out.select("session_id", F.when(free & F.col("face_id").isNotNull(), "passed").otherwise("rejected").alias("decision"), F.concat_ws("|", reasons).alias("reasons"), F.when(free, mask_document_number(F.col("face_id"))).alias("face"))


def g4_template_protection(spark, sf):
    refs, selfies = _people(spark, sf)
    key = b"protection-key"
    r = matching.protect_templates(refs.select("identity", F.col("embedding").alias("rv")), key, "rv")
    s = matching.protect_templates(selfies, key)
    return s.join(r, "identity").select("vec_id", F.round(matching.dot(F.col("embedding"), F.col("rv")), 5).alias("product"))


def g5_reference_split(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_extract("url", r"//([^/]+)/", 1).alias("identity"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("name"))
    return matching.split_references(files, ("page=2", "fr/"))


def g6_genuine_pairs(spark, sf):
    return matching.genuine_pairs(*_people(spark, sf)).groupBy("pair").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def g7_impostor_pairs(spark, sf):
    return matching.impostor_pairs(*_people(spark, sf)).select("ref_id", "selfie_id", "score")


def g8_error_rates(spark, sf):
    out = metrics.error_rates(_pairs(spark, sf), 0.55)
    return out.select("threshold", F.round("far", 9).alias("far"), F.round("frr", 9).alias("frr"))


def g9_threshold_sweep(spark, sf):
    return metrics.threshold_sweep(_pairs(spark, sf)).select(F.round("threshold", 4).alias("threshold"), F.round("far", 4).alias("far"), F.round("frr", 4).alias("frr"))


def g10_equal_error(spark, sf):
    return metrics.equal_error(metrics.threshold_sweep(_pairs(spark, sf))).select(F.round("threshold", 4).alias("threshold"), F.round("far", 4).alias("far"), F.round("frr", 4).alias("frr"))


def g11_pair_summary(spark, sf):
    return metrics.pair_summary(_pairs(spark, sf)).select("pair", "n", F.round("mean_score", 4).alias("mean_score"))


def _predictions(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    word = lambda c: F.when(c, "fraud").otherwise("genuine")
    return rows.select("doc_id", F.col("source").alias("folder"), word(F.col("quality") == 0).alias("expected"), word((F.col("n_chars") < 400) | (F.col("toxic") == 1)).alias("predicted"))


RATES = ("accuracy", "false_reject", "false_accept", "precision_share", "recall_share")


def g12_confusion(spark, sf):
    out = metrics.confusion(_predictions(spark, sf), "fraud")
    return out.select("n", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in RATES))


def g13_folder_totals(spark, sf):
    return metrics.folder_totals(_predictions(spark, sf)).select("folder", "is_total", "total", "rejected", F.round("correct_share", 6).alias("correct_share"))


def g14_spoof_confusion(spark, sf):
    f = bind(spark, sf, "frames")
    predicted = metrics.spoof_prediction(F.col("risk"), F.col("model_risk") < 0.72, F.col("has_face"), F.col("screen_frame") >= 0.62, 0.5)
    rows = f.select(F.when(F.col("event_id") % 5 == 0, "spoof").otherwise("live").alias("expected"), predicted.alias("predicted"))
    return metrics.confusion(rows, "spoof").select("n", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in RATES))


def g15_mistakes(spark, sf):
    return _predictions(spark, sf).where("expected <> predicted")


def _read_names(spark, sf):
    """Whole part names and readings of them; every 4th has letters taken for digits."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return p.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("doc_id") % 4 == 0, F.translate("p_name", "oil", "011")).otherwise(F.col("p_name")).alias("read_name"))


def g18_char_accuracy(spark, sf):
    r = _read_names(spark, sf)
    return r.select("doc_id", (F.coalesce("name", F.lit("")) == F.coalesce("read_name", F.lit(""))).alias("is_exact"), F.round(metrics.char_accuracy(F.col("name"), F.col("read_name")), 6).alias("accuracy"))


def g20_seeded_sample(spark, sf):
    return metrics.seeded_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100, "seed")


QUERIES = [g1_match_scores, g2_identify, g3_face_login, g4_template_protection, g5_reference_split, g6_genuine_pairs, g7_impostor_pairs, g8_error_rates, g9_threshold_sweep, g10_equal_error, g11_pair_summary,
           g12_confusion, g13_folder_totals, g14_spoof_confusion, g15_mistakes, g18_char_accuracy, g20_seeded_sample]

_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_SCORE = "round(greatest(0, least(1, (" + _DOT + " + 1) / 2)), 4)"
PEOPLE = f"""WITH f AS (SELECT label AS identity, min(vec_id) AS ref FROM embeddings GROUP BY label), refs AS (SELECT e.vec_id AS ref_id, e.label AS identity, e.embedding AS rv FROM embeddings e JOIN f ON f.ref = e.vec_id),
 selfies AS (SELECT e.vec_id AS selfie_id, e.label AS identity, e.embedding AS sv FROM embeddings e JOIN f ON f.identity = e.label WHERE e.vec_id <> f.ref),
 gen AS (SELECT 'genuine' AS pair, ref_id, selfie_id, {_SCORE.format('rv', 'sv')} AS score FROM refs JOIN selfies USING (identity)),
 ring AS (SELECT identity, row_number() OVER (ORDER BY md5(CAST(identity AS VARCHAR)), identity) - 1 AS place, count(*) OVER () AS n FROM refs),
 meets AS (SELECT a.identity, b.identity AS other, j FROM ring a, (SELECT unnest(range(1, 9)) AS j) s, ring b WHERE j < a.n AND b.place = (a.place + j) % a.n),
 few AS (SELECT * FROM selfies QUALIFY row_number() OVER (PARTITION BY identity ORDER BY selfie_id) <= 8),
 imp AS (SELECT 'impostor' AS pair, ref_id, selfie_id, {_SCORE.format('rv', 'sv')} AS score FROM (SELECT r.ref_id, r.rv, w.selfie_id, w.sv FROM refs r JOIN meets m ON m.identity = r.identity JOIN few w ON w.identity = m.other
  QUALIFY row_number() OVER (PARTITION BY r.ref_id ORDER BY m.j, w.selfie_id) <= 8)), pairs AS (SELECT * FROM gen UNION ALL SELECT * FROM imp)
"""
SWEEP = PEOPLE + """, sweep AS (SELECT t / 10000.0::DOUBLE AS threshold, coalesce(avg(CASE WHEN round(score * 10000)::INT >= t THEN 1.0 ELSE 0 END) FILTER (pair = 'impostor'), 0) AS far,
 coalesce(avg(CASE WHEN round(score * 10000)::INT < t THEN 1.0 ELSE 0 END) FILTER (pair = 'genuine'), 0) AS frr FROM pairs, (SELECT unnest(range(2000, 9401, 200)) AS t) GROUP BY t)
"""
PRED = """WITH p AS (SELECT doc_id, source AS folder, CASE WHEN quality = 0 THEN 'fraud' ELSE 'genuine' END AS expected, CASE WHEN n_chars < 400 OR toxic = 1 THEN 'fraud' ELSE 'genuine' END AS predicted FROM labels JOIN documents USING (doc_id))
"""
_CONF = """c AS (SELECT count(*) AS n, count(*) FILTER (expected = '{0}' AND predicted = '{0}') AS tp, count(*) FILTER (expected <> '{0}' AND predicted = '{0}') AS fp, count(*) FILTER (expected = '{0}' AND predicted <> '{0}') AS fn, count(*) FILTER (expected <> '{0}' AND predicted <> '{0}') AS tn FROM p)
 SELECT n, tp, fp, fn, tn, round((tp + tn) / greatest(n, 1), 6) AS accuracy, round(fp / greatest(fp + tn, 1), 6) AS false_reject, round(fn / greatest(fn + tp, 1), 6) AS false_accept, round(tp / greatest(tp + fp, 1), 6) AS precision_share, round(tp / greatest(tp + fn, 1), 6) AS recall_share FROM c"""

SQL = {
    "g1_match_scores": PEOPLE + "SELECT ref_id, selfie_id, score FROM gen",
    "g2_identify": oracle(f"--with s AS (SELECT p.vec_id AS probe_id, g.face_id, {_SCORE.format('p.embedding', 'g.embedding')} AS score FROM embedded p, embedded g WHERE p.is_probe AND NOT g.is_probe AND g.active), b AS (SELECT probe_id, max(score) AS top FROM s GROUP BY probe_id) SELECT b.probe_id, CASE WHEN top >= 0.6::DOUBLE THEN min(face_id) END AS face_id, round(top, 2) AS score FROM b JOIN s ON s.probe_id = b.probe_id AND s.score = b.top GROUP BY b.probe_id, top", "embedded"),
    "g3_face_login": oracle("--with " + login_sql("frames", "session_id") + f""", s AS (SELECT p.vec_id AS probe_id, g.face_id, {_SCORE.format('p.embedding', 'g.embedding')} AS score FROM embedded p, embedded g WHERE p.is_probe AND NOT g.is_probe AND g.active),
 t AS (SELECT probe_id, max(score) AS top FROM s GROUP BY probe_id), i AS (SELECT t.probe_id, CASE WHEN top >= 0.6::DOUBLE THEN min(face_id) END AS face FROM t JOIN s ON s.probe_id = t.probe_id AND s.score = t.top GROUP BY t.probe_id, top)
 SELECT session AS session_id, CASE WHEN len(reasons) = 0 AND face IS NOT NULL THEN 'passed' ELSE 'rejected' END AS decision, CASE WHEN len(reasons) = 0 AND face IS NULL THEN 'FACE_LOGIN_NO_MATCH' ELSE array_to_string(reasons, '|') END AS reasons,
 CASE WHEN len(reasons) = 0 THEN substr(face, 1, 2) || repeat('•', length(face) - 4) || right(face, 2) END AS face FROM login LEFT JOIN i ON i.probe_id = event_id % 50 * 10""", "frames", "embedded"),
    "g4_template_protection": PEOPLE + f"SELECT selfie_id AS vec_id, round({_DOT.format('sv', 'rv')}, 5) AS product FROM selfies JOIN refs USING (identity)",
    "g5_reference_split": """WITH f AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS identity, url || '#' || page_id AS name FROM pages) SELECT identity, name, CASE WHEN count(*) OVER (PARTITION BY identity) < 2 THEN 'skipped' WHEN row_number() OVER (PARTITION BY identity ORDER BY regexp_matches(lower(name), 'page=2|fr/') DESC, name) = 1 THEN 'reference' ELSE 'selfie' END AS role FROM f""",
    "g6_genuine_pairs": PEOPLE + "SELECT pair, count(*) AS n, round(avg(score), 4) AS mean_score FROM gen GROUP BY pair",
    "g7_impostor_pairs": PEOPLE + "SELECT ref_id, selfie_id, score FROM imp",
    "g8_error_rates": PEOPLE + "SELECT 0.55::DOUBLE AS threshold, round(coalesce(avg(CASE WHEN score >= 0.55::DOUBLE THEN 1.0 ELSE 0 END) FILTER (pair = 'impostor'), 0), 9) AS far, round(coalesce(avg(CASE WHEN score < 0.55::DOUBLE THEN 1.0 ELSE 0 END) FILTER (pair = 'genuine'), 0), 9) AS frr FROM pairs",
    "g9_threshold_sweep": SWEEP + "SELECT round(threshold, 4) AS threshold, round(far, 4) AS far, round(frr, 4) AS frr FROM sweep",
    "g10_equal_error": SWEEP + "SELECT round(threshold, 4) AS threshold, round(far, 4) AS far, round(frr, 4) AS frr FROM sweep ORDER BY abs(far - frr), threshold LIMIT 1",
    "g11_pair_summary": PEOPLE + "SELECT pair, count(*) AS n, round(avg(score), 4) AS mean_score FROM pairs GROUP BY pair",
    "g12_confusion": PRED + ", " + _CONF.format("fraud"),
    "g13_folder_totals": PRED + "SELECT folder, grouping(folder)::INT AS is_total, count(*) AS total, count(*) FILTER (predicted = 'fraud') AS rejected, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0 END), 6) AS correct_share FROM p GROUP BY GROUPING SETS ((folder), ())",
    "g14_spoof_confusion": oracle("--with p AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'spoof' ELSE 'live' END AS expected, CASE WHEN risk >= 0.5::DOUBLE OR model_risk >= 0.72::DOUBLE OR NOT has_face OR screen_frame >= 0.62::DOUBLE THEN 'spoof' ELSE 'live' END AS predicted FROM frames), " + _CONF.format("spoof"), "frames"),
    "g15_mistakes": PRED + "SELECT * FROM p WHERE expected <> predicted",
    "g18_char_accuracy": """WITH r AS (SELECT p_partkey AS doc_id, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_name END, '') AS a, coalesce(CASE WHEN p_partkey % 4 = 0 THEN translate(p_name, 'oil', '011') ELSE p_name END, '') AS b FROM part)
 SELECT doc_id, a = b AS is_exact, round(CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS accuracy FROM r""",
    "g20_seeded_sample": "SELECT doc_id, source FROM documents ORDER BY md5('seed:' || doc_id), doc_id LIMIT 100",
}
