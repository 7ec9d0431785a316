"""Queries over document and selfie scores and the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions import signals as sg
from sealmark.functions.scalars import clamp, keyword_hits
from sealmark.operators import scoring
from sealmark.plans.bindings import bind, oracle, table

KEYWORDS = ("the", "and", "license", "rights", "token", "und", "les")


def _packed(spark, sf):
    """Signals of each document as one array, in order."""
    rows = bind(spark, sf, "signals").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("code", "severity", "score").alias("s")))).alias("a"))
    return rows.select("doc_id", F.col("a.s").alias("signals"))


def b10_clamp_scores(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(clamp(F.col("value") * 0.0137 - 0.2), 2).alias("score"))


def b16_signal_dedupe(spark, sf):
    return _packed(spark, sf).select("doc_id", sg.dedupe(F.col("signals")).alias("s")).select("doc_id", sg.codes(F.col("s")).alias("codes"), F.round(sg.total(F.col("s"), lambda s: s["score"]), 4).alias("total"))


def b17_keyword_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(",", keyword_hits(F.lower("text"), KEYWORDS)).alias("hits"))


def c1_document_quality(spark, sf):
    return scoring.document_quality(bind(spark, sf, "metrics")).select("doc_id", F.round("quality_score", 4).alias("score"), sg.codes(F.col("quality_signals")).alias("codes"))


def c2_document_likeness(spark, sf):
    return scoring.document_likeness(bind(spark, sf, "metrics")).select("doc_id", F.round("likeness_score", 6).alias("score"), sg.codes(F.col("likeness_signals")).alias("codes"))


def c3_forensic_risk(spark, sf):
    return scoring.forensic_risk(bind(spark, sf, "metrics")).select("doc_id", F.round("recapture_risk", 6).alias("recapture"), F.round("tamper_risk", 6).alias("tamper"), sg.codes(F.col("forensic_signals")).alias("codes"))


def c4_model_ensemble(spark, sf):
    cols = ("recapture", "tamper", "fraud", "confidence")
    return scoring.document_ensemble(bind(spark, sf, "findings")).select("doc_id", *(F.round(c, 6).alias(c) for c in cols))


def c5_model_signals(spark, sf):
    return scoring.document_ensemble(bind(spark, sf, "findings")).select("doc_id", sg.codes(F.col("model_signals")).alias("codes"))


def _scored(spark, sf):
    return scoring.forensic_risk(scoring.document_likeness(scoring.document_quality(bind(spark, sf, "metrics"))))


def c6_model_adapters(spark, sf):
    k = F.col("doc_id")
    rows = _scored(spark, sf).withColumns({"edge_mean": (k * 53 % 200).cast("double"), "edge_spread": (k * 59 % 140).cast("double")})
    places = {"liveness_model": 6, "liveness_confidence": 9, "tamper_model": 6, "tamper_confidence": 9}
    return scoring.adapter_scores(rows).select("doc_id", *(F.round(c, n).alias(c) for c, n in places.items()))


def c6_portrait(spark, sf):
    """Region measures from arithmetic on the order's key."""
    k = F.col("o_orderkey")
    region = lambda a, top, *more: F.struct((k * a % 80).cast("double").alias("contrast"), (k * (a + 4) % 61 / 10.0).alias("noise"), (k * (a + 10) % 160).cast("double").alias("saturation"), (k * (a + 16) % 50 / 100.0).alias("dark_ratio"), *more)
    rows = table(spark, sf, "orders").select(
        k.alias("doc_id"), region(7, 80, (k * 31 % 70 / 100.0).alias("skin_ratio")).alias("photo"), region(13, 60).alias("body"),
        F.when(k % 6 == 0, "id_card").otherwise("passport").alias("document_type"), (k % 3 == 0).alias("mrz_valid"), (k * 7919 % 1200000).alias("pixels"),
    )
    return scoring.portrait_scores(rows).select("doc_id", F.round("portrait_model", 6).alias("score"), F.round("portrait_confidence", 10).alias("confidence"))


def _risk(spark, sf):
    models = scoring.document_ensemble(bind(spark, sf, "findings")).select("doc_id", "fraud", F.col("recapture").alias("model_recapture"), F.col("tamper").alias("model_tamper"), "confidence")
    docs = _scored(spark, sf).join(models, "doc_id").join(_packed(spark, sf), "doc_id")
    return scoring.document_risk(docs)


def c7_document_risk(spark, sf):
    return _risk(spark, sf).select("doc_id", "status", "fraud_risk_score")


def c8_face_required(spark, sf):
    face = F.array(sg.signal("FACE_NOT_FOUND", "high", 0.9)).cast(sg.TYPE)
    docs = _risk(spark, sf).withColumns({"template": F.when(F.col("doc_id") % 4 != 0, F.lit("t")), "face_signals": face})
    return scoring.face_required(docs).select("doc_id", "status", F.size("signals").cast("long").alias("n_signals"))


def _pad_models(spark, sf):
    e = bind(spark, sf, "frames")
    rows = e.select("event_id", F.explode(F.array(*(F.struct(
        F.lit("primary" if k == 0 else "companion").alias("family"), (((F.col("event_id") * (83 + 6 * k)) % 101).cast("double") / 100).alias("risk"),
        (((F.col("event_id") * (89 + 10 * k)) % 97).cast("double") / 100).alias("confidence"), F.when((F.col("event_id") + k) % 3 != 0, "available").otherwise("failed").alias("status"),
    ) for k in range(3)))).alias("m"))
    return scoring.pad_models(rows.select("event_id", "m.*"), "event_id")


def c9_pad_frames(spark, sf):
    frames = bind(spark, sf, "frames").withColumn("n_models", F.col("event_id") % 2)
    out = scoring.pad_frames(frames)
    return out.select("event_id", F.round("pad_risk", 6).alias("risk"), "pad_passed", sg.codes(F.col("pad_signals")).alias("codes"))


def c10_pad_models(spark, sf):
    cols = ("primary_risk", "companion_risk", "model_risk")
    return _pad_models(spark, sf).select("event_id", "n_models", *(F.round(c, 6).alias(c) for c in cols))


def c10_softmax(spark, sf):
    e = table(spark, sf, "events")
    logits = F.when(F.col("event_id") % 2 == 0, F.array(F.col("value") / 50, F.lit(1.0))).otherwise(F.array(F.col("value") / 60, F.lit(0.5), F.col("value") / 90))
    return e.select("event_id", scoring.class_probabilities(logits).alias("p")).select("event_id", F.round("p.real", 9).alias("real_share"), F.round("p.spoof", 9).alias("spoof_share"), F.round("p.confidence", 9).alias("confidence"))


def selfies(spark, sf):
    frames = bind(spark, sf, "frames").withColumns({"n_models": F.col("event_id") % 2, "frame_brightness": ((F.col("event_id") * 79) % 256).cast("double"), "has_reference": F.col("event_id") % 19 != 0})
    return scoring.selfie_frames(scoring.pad_frames(frames))


def c11_selfie_frames(spark, sf):
    return selfies(spark, sf).select("event_id", F.round("selfie_quality", 6).alias("quality"), F.round("selfie_risk", 6).alias("risk"), "selfie_passed", sg.codes(F.col("selfie_signals")).alias("codes"))


def decisions(spark, sf):
    s = bind(spark, sf, "steps")
    one = lambda on, code, sev: F.array_compact(F.array(F.when(on, sg.signal(code, sev, 0.5)))).cast(sg.TYPE)
    k = F.col("k")
    return scoring.decide(s.select(
        "seq", F.when(k % 10 == 0, "rejected").when(k % 10 == 1, "pending").otherwise("passed").alias("document_status"), one(k % 7 == 0, "LOW_RESOLUTION", "high").alias("document_signals"),
        (F.col("value") / 500).alias("fraud_risk_score"), (k % 3 != 0).alias("active_passed"), one(k % 5 == 0, "ACTIVE_LIVENESS_REPLAY_DETECTED", "high").alias("active_signals"),
        (k % 4 != 0).alias("hand_passed"), one(k % 6 == 0, "FACE_MATCH_LOW", "high").alias("selfie_signals"), F.when(k % 8 == 0, 0.0).otherwise(0.6 + k / 300).alias("face_match_score"),
        (k % 2 != 0).alias("passive_passed"), (k % 9 != 0).alias("contact_confirmed"),
    ), contact_required=True)


def c12_decision(spark, sf):
    return decisions(spark, sf).select("seq", F.concat_ws("|", "reason_codes").alias("reasons"), "decision")


def c13_top_signals(spark, sf):
    return scoring.top_signals(_packed(spark, sf), "signals", 10)


QUERIES = [b10_clamp_scores, b16_signal_dedupe, b17_keyword_hits, c1_document_quality, c2_document_likeness, c3_forensic_risk, c4_model_ensemble, c5_model_signals, c6_model_adapters, c6_portrait, c7_document_risk,
           c8_face_required, c9_pad_frames, c10_pad_models, c10_softmax, c11_selfie_frames, c12_decision, c13_top_signals]


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _codes(*rungs) -> str:
    """concat_ws of CASE texts; a rung is [(condition, code), ...]."""
    cases = (" ".join(["CASE", *(f"WHEN {c} THEN '{code}'" for c, code in rung), "END"]) for rung in rungs)
    return "concat_ws('|', " + ", ".join(cases) + ")"


Q_CODES = _codes([("pixels < 350000", "LOW_RESOLUTION")], [("(brightness < 45 OR brightness > 238) AND contrast < 32", "POOR_LIGHTING")], [("contrast < 20", "LOW_CONTRAST")],
                 [("sharpness < 2", "BLUR_DETECTED"), ("sharpness < 5", "LOW_SHARPNESS")], [("glare_ratio > 0.12::DOUBLE", "GLARE_OR_WASHOUT")],
                 [("NOT regexp_matches(lower(filename), '\\.(jpg|jpeg|png|webp)$')", "UNSUPPORTED_FILE_TYPE")])
SCORED = f"""--with q AS (SELECT *, {_clamp('''0.28::DOUBLE + CASE WHEN pixels >= 900000 THEN 0.22::DOUBLE WHEN pixels >= 450000 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN brightness BETWEEN 65 AND 215 THEN 0.18::DOUBLE ELSE 0.04::DOUBLE END
 + CASE WHEN contrast >= 32 THEN 0.18::DOUBLE WHEN contrast >= 20 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN sharpness >= 12 THEN 0.16::DOUBLE WHEN sharpness >= 7 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN glare_ratio <= 0.08::DOUBLE THEN 0.08::DOUBLE ELSE 0 END''')} AS quality,
 CASE WHEN aspect < 0.62::DOUBLE THEN {_clamp('1 - (0.62::DOUBLE - aspect) / 0.7::DOUBLE')} WHEN aspect > 1.95::DOUBLE THEN {_clamp('1 - (aspect - 1.95::DOUBLE) / 0.7::DOUBLE')} ELSE 1.0::DOUBLE END AS asp,
 {_clamp('blockiness * 0.52::DOUBLE + saturation * 0.24::DOUBLE + greatest(glare_ratio - 0.1::DOUBLE, 0) * 0.9::DOUBLE')} AS rec, {_clamp('ela_score * 0.68::DOUBLE + blockiness * 0.24::DOUBLE + saturation * 0.08::DOUBLE')} AS tam FROM metrics),
sc AS (SELECT *, {_clamp(f"edge_density * 0.42::DOUBLE + {_clamp('asp * 0.55::DOUBLE + border_score * 0.45::DOUBLE')} * 0.58::DOUBLE")} AS likeness FROM q)
"""
FAMILY = "coalesce(" + _clamp("greatest(sum(score * greatest(confidence, 0.05::DOUBLE)) FILTER (status = 'available' AND family = '{0}') / sum(greatest(confidence, 0.05::DOUBLE)) FILTER (status = 'available' AND family = '{0}'), 0.9::DOUBLE * max(score) FILTER (status = 'available' AND family = '{0}'))") + " * 1, 0)"
MODEL = "coalesce(max(score) FILTER (status = 'available' AND model_id = '{0}'), 0)"
ENSEMBLE = f"""e0 AS (SELECT doc_id, count(*) FILTER (status = 'available' AND family = 'document_liveness') AS nl, count(*) FILTER (status = 'available' AND family = 'tamper') AS nt, count(*) FILTER (status = 'available' AND family = 'general_fraud') AS ng,
 {FAMILY.format('document_liveness')} AS r0, {FAMILY.format('tamper')} AS t0, {FAMILY.format('general_fraud')} AS g0, coalesce(avg(confidence) FILTER (status = 'available'), 0) AS confidence,
 {MODEL.format('heuristic_print_copy_v1')} AS pc, {MODEL.format('heuristic_portrait_substitution_v1')} AS po FROM findings GROUP BY doc_id),
e1 AS (SELECT *, CASE WHEN nl = 0 THEN 0 ELSE r0 END AS recapture, CASE WHEN nt = 0 THEN 0 ELSE t0 END AS tamper, CASE WHEN ng = 0 THEN 0 ELSE g0 END AS general FROM e0),
ens AS (SELECT *, {_clamp('greatest(general, recapture * 0.45::DOUBLE + tamper * 0.55::DOUBLE)')} AS fraud FROM e1)
"""
M_CODES = _codes(
    [("pc >= 0.62::DOUBLE", "DOCUMENT_PRINT_COPY_RISK_HIGH"), ("pc >= 0.42::DOUBLE", "DOCUMENT_PRINT_COPY_RISK_MEDIUM")], [("po >= 0.55::DOUBLE", "DOCUMENT_FACE_SUBSTITUTION_RISK_HIGH"), ("po >= 0.38::DOUBLE", "DOCUMENT_FACE_SUBSTITUTION_RISK_MEDIUM")],
    [("recapture >= 0.76::DOUBLE AND confidence >= 0.55::DOUBLE", "DOCUMENT_RECAPTURE_MODEL_RISK_HIGH"), ("recapture >= 0.58::DOUBLE", "DOCUMENT_RECAPTURE_MODEL_RISK_MEDIUM")],
    [("tamper >= 0.74::DOUBLE AND confidence >= 0.55::DOUBLE", "DOCUMENT_TAMPER_MODEL_RISK_HIGH"), ("tamper >= 0.56::DOUBLE", "DOCUMENT_TAMPER_MODEL_RISK_MEDIUM")],
    [("fraud >= 0.78::DOUBLE AND confidence >= 0.62::DOUBLE", "DOCUMENT_FRAUD_MODEL_RISK_HIGH"), ("fraud >= 0.6::DOUBLE", "DOCUMENT_FRAUD_MODEL_RISK_MEDIUM")])
RISK = f"""{SCORED}, {ENSEMBLE}, sp AS (SELECT doc_id, count(*) AS n, sum(CASE severity WHEN 'high' THEN 0.62::DOUBLE WHEN 'medium' THEN 0.34::DOUBLE ELSE 0.16::DOUBLE END * score) AS pressure FROM signals GROUP BY doc_id),
rk AS (SELECT sc.doc_id, quality, likeness, sp.n, {_clamp('pressure + (1 - quality) * 0.34::DOUBLE + (1 - likeness) * 0.3::DOUBLE + rec * 0.22::DOUBLE + tam * 0.28::DOUBLE + (fraud * 0.34::DOUBLE + recapture * 0.12::DOUBLE + tamper * 0.16::DOUBLE) * greatest(confidence, 0.35::DOUBLE)')} AS risk
 FROM sc JOIN ens USING (doc_id) JOIN sp USING (doc_id)), st AS (SELECT *, CASE WHEN risk > 0.72::DOUBLE OR quality < 0.34::DOUBLE OR likeness < 0.34::DOUBLE THEN 'rejected' ELSE 'passed' END AS status FROM rk)
"""
_HEUR = _clamp("glare_ratio * 1.6::DOUBLE + saturation * 1.2::DOUBLE + moire * 0.38::DOUBLE + screen_frame * 0.9::DOUBLE + display_surface * 0.9::DOUBLE + paper_photo * 1.05::DOUBLE + held_phone * 1.15::DOUBLE + " + _clamp("(22 - contrast) / 22")
               + " * 0.22::DOUBLE + CASE WHEN brightness > 232 OR brightness < 38 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN sharpness < 2.2::DOUBLE THEN 0.14::DOUBLE ELSE 0 END")
PAD_RUNGS = [
    [("pad_risk >= 0.62::DOUBLE", "PASSIVE_SPOOF_RISK_HIGH"), ("pad_risk >= 0.38::DOUBLE", "PASSIVE_SPOOF_RISK_MEDIUM")], [("glare_ratio > 0.16::DOUBLE", "SELFIE_SCREEN_GLARE")], [("moire > 0.6::DOUBLE", "SELFIE_SCREEN_PATTERN")],
    [("screen_frame >= 0.62::DOUBLE", "SELFIE_PHONE_SCREEN_FRAME"), ("screen_frame >= 0.42::DOUBLE", "SELFIE_POSSIBLE_SCREEN_FRAME")], [("held_phone >= 0.52::DOUBLE", "SELFIE_HELD_PHONE_SCREEN"), ("held_phone >= 0.36::DOUBLE", "SELFIE_POSSIBLE_HELD_PHONE_SCREEN")],
    [("display_surface >= 0.58::DOUBLE", "SELFIE_TABLET_SCREEN_SURFACE"), ("display_surface >= 0.4::DOUBLE", "SELFIE_POSSIBLE_DISPLAY_SURFACE")], [("paper_photo >= 0.56::DOUBLE", "SELFIE_PRINTED_PHOTO_PAPER"), ("paper_photo >= 0.38::DOUBLE", "SELFIE_POSSIBLE_PRINTED_PHOTO")],
    [("event_id % 2 > 0 AND model_risk >= 0.72::DOUBLE", "PAD_MODEL_SPOOF_HIGH"), ("event_id % 2 > 0 AND model_risk >= 0.52::DOUBLE", "PAD_MODEL_SPOOF_MEDIUM")]]
PAD = f"--with pad AS (SELECT *, greatest({_HEUR}, model_risk) AS pad_risk FROM frames)"
PASSED = "pad_risk < 0.5::DOUBLE AND screen_frame < 0.62::DOUBLE AND display_surface < 0.58::DOUBLE AND held_phone < 0.52::DOUBLE AND model_risk < 0.72::DOUBLE"

# each rung: condition, code, severity, score; hand-written for DuckDB
_S = [
    [("pixels < 220000", "SELFIE_LOW_RESOLUTION", "h", "0.76")], [("brightness < 45 OR brightness > 235", "SELFIE_POOR_LIGHTING", "m", "0.5"), ("has_face AND brightness < 80 AND (event_id * 79) % 256 - brightness > 45", "SELFIE_FACE_UNDEREXPOSED", "m", "0.4")],
    [("contrast < 16", "SELFIE_LOW_CONTRAST", "m", "0.42")], [("sharpness < 1.4::DOUBLE", "SELFIE_BLUR_DETECTED", "h", "0.78"), ("sharpness < 3.2::DOUBLE", "SELFIE_LOW_SHARPNESS", "m", "0.28")],
    [("skin_ratio < 0.04::DOUBLE", "FACE_NOT_CENTERED", "h", "0.72"), ("skin_ratio < 0.08::DOUBLE", "FACE_CENTER_WEAK", "m", "0.36")], [("glare_ratio > 0.18::DOUBLE", "SELFIE_GLARE_OR_SCREEN_RISK", "m", "0.48")],
    [("has_face AND face_width < 0.22::DOUBLE", "SELFIE_FACE_TOO_SMALL", "m", "0.2")],
]
_OWN = {"PASSIVE": "pad_risk", "SELFIE_SCREEN_GLARE": "glare_ratio", "SELFIE_SCREEN_PATTERN": "moire", "SELFIE_PHONE": "screen_frame", "SELFIE_POSSIBLE_SCREEN": "screen_frame", "SELFIE_HELD": "held_phone", "SELFIE_POSSIBLE_HELD": "held_phone",
        "SELFIE_TABLET": "display_surface", "SELFIE_POSSIBLE_DISPLAY": "display_surface", "SELFIE_PRINTED": "paper_photo", "SELFIE_POSSIBLE_PRINTED": "paper_photo", "PAD_MODEL": "model_risk"}
_S += [[(c, code, "m" if "_MEDIUM" in code or "POSSIBLE" in code or "GLARE" in code or "PATTERN" in code else "h", next(v for k, v in _OWN.items() if code.startswith(k))) for c, code in rung] for rung in PAD_RUNGS]
_S += [[("event_id % 19 = 0", "PASSPORT_FACE_REFERENCE_MISSING", "h", "0.92"), ("has_face AND face_match < 0.68::DOUBLE", "FACE_MATCH_LOW", "h", "1 - face_match"), ("has_face AND face_match < 0.74::DOUBLE", "FACE_MATCH_BORDERLINE", "m", "1 - face_match")]]
_SUM = " + ".join("CASE " + " ".join(f"WHEN {c} THEN {'0.28' if sev == 'm' else '0.48'}::DOUBLE * round({_clamp(f'({x})::DOUBLE')}, 2)" for c, _, sev, x in rung) + " ELSE 0 END" for rung in _S)
_HIGH = " OR ".join("coalesce(CASE " + " ".join(f"WHEN {c} THEN {'true' if sev == 'h' else 'false'}" for c, _, sev, _x in rung) + " END, false)" for rung in _S)
SELFIE = oracle(PAD + f""", sq AS (SELECT *, {_clamp('0.24::DOUBLE + CASE WHEN pixels >= 450000 THEN 0.2::DOUBLE WHEN pixels >= 220000 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN brightness BETWEEN 55 AND 220 THEN 0.18::DOUBLE ELSE 0.04::DOUBLE END + CASE WHEN contrast >= 24 THEN 0.18::DOUBLE WHEN contrast >= 16 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN sharpness >= 7 THEN 0.16::DOUBLE WHEN sharpness >= 3.2::DOUBLE THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN skin_ratio >= 0.08::DOUBLE THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN glare_ratio <= 0.12::DOUBLE THEN 0.1::DOUBLE ELSE 0 END')} AS q0,
 {_SUM} AS worth, {_HIGH} AS any_high, {_codes(*([(c, code) for c, code, _, _x in rung] for rung in _S))} AS codes, {PASSED} AS pad_ok, CASE WHEN event_id % 19 <> 0 AND has_face THEN face_match ELSE 0 END AS match FROM pad),
 s2 AS (SELECT *, greatest({_clamp('(1 - q0) * 0.55::DOUBLE + glare_ratio * 0.35::DOUBLE + CASE WHEN skin_ratio < 0.08::DOUBLE THEN 0.18::DOUBLE ELSE 0 END + worth')}, round(pad_risk, 3)) AS r0 FROM sq),
 sr AS (SELECT *, NOT any_high AND pad_ok AND r0 <= 0.5::DOUBLE AND q0 >= 0.46::DOUBLE AND match >= 0.68::DOUBLE AS passed FROM s2)
""", "frames")

SQL = {
    "b10_clamp_scores": f"SELECT event_id, round({_clamp('value * 0.0137::DOUBLE - 0.2::DOUBLE')}, 2) AS score FROM events",
    "b17_keyword_hits": "SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'and') THEN 'and' END, CASE WHEN contains(t, 'les') THEN 'les' END, CASE WHEN contains(t, 'license') THEN 'license' END, CASE WHEN contains(t, 'rights') THEN 'rights' END, CASE WHEN contains(t, 'the') THEN 'the' END, CASE WHEN contains(t, 'token') THEN 'token' END, CASE WHEN contains(t, 'und') THEN 'und' END) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)",
    "c1_document_quality": oracle(SCORED + f"SELECT doc_id, round(quality, 4) AS score, {Q_CODES} AS codes FROM sc", "metrics"),
    "c2_document_likeness": oracle(SCORED + f"SELECT doc_id, round(likeness, 6) AS score, {_codes([('asp < 0.45::DOUBLE', 'UNUSUAL_DOCUMENT_ASPECT')], [('likeness < 0.38::DOUBLE', 'NON_DOCUMENT_UPLOAD'), ('likeness < 0.55::DOUBLE', 'WEAK_DOCUMENT_STRUCTURE')])} AS codes FROM sc", "metrics"),
    "c3_forensic_risk": oracle(SCORED + f"SELECT doc_id, round(rec, 6) AS recapture, round(tam, 6) AS tamper, {_codes([('rec >= 0.62::DOUBLE', 'RECAPTURE_RISK_HIGH'), ('rec >= 0.44::DOUBLE', 'RECAPTURE_RISK_MEDIUM')], [('tam >= 0.64::DOUBLE', 'TAMPER_RISK_HIGH'), ('tam >= 0.46::DOUBLE', 'TAMPER_RISK_MEDIUM')])} AS codes FROM sc", "metrics"),
    "c4_model_ensemble": oracle("--with " + ENSEMBLE + "SELECT doc_id, round(recapture, 6) AS recapture, round(tamper, 6) AS tamper, round(fraud, 6) AS fraud, round(confidence, 6) AS confidence FROM ens", "findings"),
    "c5_model_signals": oracle("--with " + ENSEMBLE + f"SELECT doc_id, {M_CODES} AS codes FROM ens", "findings"),
    "c6_model_adapters": oracle(SCORED + f"""SELECT doc_id, round({_clamp('blockiness * 0.34::DOUBLE + ' + _clamp('(doc_id * 53 % 200)::DOUBLE / 255 * 0.55::DOUBLE + (doc_id * 59 % 140)::DOUBLE / 128 * 0.45::DOUBLE') + ' * 0.28::DOUBLE + glare_ratio * 1.1::DOUBLE * 0.18::DOUBLE + saturation * 0.9::DOUBLE * 0.1::DOUBLE + ' + _clamp('(26 - contrast) / 26') + ' * 0.06::DOUBLE + ' + _clamp('(0.55::DOUBLE - likeness) / 0.55::DOUBLE') + ' * 0.04::DOUBLE')}, 6) AS liveness_model,
 round(least(1.0::DOUBLE, 0.58::DOUBLE + least(pixels / 3000000.0::DOUBLE, 0.32::DOUBLE)), 9) AS liveness_confidence,
 round({_clamp('ela_score * 0.55::DOUBLE + blockiness * 0.24::DOUBLE + saturation * 0.11::DOUBLE + ' + _clamp('(0.55::DOUBLE - least(likeness, quality)) / 0.55::DOUBLE') + ' * 0.1::DOUBLE')}, 6) AS tamper_model, round(least(1.0::DOUBLE, 0.52::DOUBLE + least(pixels / 3400000.0::DOUBLE, 0.35::DOUBLE)), 9) AS tamper_confidence FROM sc""", "metrics"),
    "c6_portrait": f"""WITH m AS (SELECT o_orderkey AS doc_id, o_orderkey * 7 % 80 AS pc, o_orderkey * 11 % 61 / 10.0::DOUBLE AS pn, o_orderkey * 17 % 160 AS ps, o_orderkey * 23 % 50 / 100.0::DOUBLE AS pd, o_orderkey * 31 % 70 / 100.0::DOUBLE AS skin,
 o_orderkey * 13 % 80 AS bc, o_orderkey * 17 % 61 / 10.0::DOUBLE AS bn, o_orderkey * 23 % 160 AS bs, o_orderkey * 29 % 50 / 100.0::DOUBLE AS bd, o_orderkey % 6 <> 0 AS passport, o_orderkey % 3 = 0 AS valid, o_orderkey * 7919 % 1200000 AS pixels FROM orders),
 r AS (SELECT *, pn / greatest(bn, 0.1::DOUBLE) AS noise, abs(ps - bs)::DOUBLE AS gap FROM m),
 s AS (SELECT *, {_clamp(_clamp("(skin - 0.16::DOUBLE) / 0.26::DOUBLE") + " * (" + _clamp("(pc / greatest(bc, 1.0::DOUBLE) - 1.55::DOUBLE) / 1.2::DOUBLE") + " * 0.4::DOUBLE + " + _clamp("abs(noise - 1) / 0.85::DOUBLE") + " * 0.2::DOUBLE + " + _clamp("gap / 75") + " * 0.14::DOUBLE + " + _clamp("(pd - bd - 0.04::DOUBLE) / 0.14::DOUBLE") + " * 0.14::DOUBLE + CASE WHEN pc > 42 AND bc < 38 THEN 0.12::DOUBLE ELSE 0 END)")} AS score FROM r)
 SELECT doc_id, round(CASE WHEN NOT passport THEN 0.0::DOUBLE WHEN valid AND gap < 22 AND noise BETWEEN 0.45::DOUBLE AND 0.9::DOUBLE THEN least(score, 0.32::DOUBLE) ELSE score END, 6) AS score,
 round(CASE WHEN passport THEN 0.62::DOUBLE + least(pixels / 3200000.0::DOUBLE, 0.28::DOUBLE) ELSE 0.0::DOUBLE END, 10) AS confidence FROM s""",
    "c7_document_risk": oracle(RISK + "SELECT doc_id, status, round(risk, 2) AS fraud_risk_score FROM st", "metrics", "findings", "signals"),
    "c8_face_required": oracle(RISK + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE status END AS status, n + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_signals FROM st", "metrics", "findings", "signals"),
    "c9_pad_frames": oracle(PAD + f"SELECT event_id, round(pad_risk, 6) AS risk, {PASSED} AS pad_passed, {_codes(*PAD_RUNGS)} AS codes FROM pad", "frames"),
    "c10_softmax": """WITH l AS (SELECT event_id, value, event_id % 2 = 0 AS two FROM events), x AS (SELECT event_id, CASE WHEN two THEN exp(value / 50) / (exp(value / 50) + exp(1.0::DOUBLE)) ELSE exp(0.5::DOUBLE) / (exp(value / 60) + exp(0.5::DOUBLE) + exp(value / 90)) END AS r FROM l)
 SELECT event_id, round(r, 9) AS real_share, round(1 - r, 9) AS spoof_share, round(abs(2 * r - 1), 9) AS confidence FROM x""",
    "c12_decision": oracle("""--with r AS (SELECT seq, k, value, concat_ws('|', CASE WHEN k % 10 = 0 THEN 'DOCUMENT_FRAUD_OR_QUALITY_FAILED' END, CASE WHEN k % 7 = 0 THEN 'LOW_RESOLUTION' END, CASE WHEN k % 10 = 1 THEN 'DOCUMENT_REQUIRED' END,
 CASE WHEN value / 500 > 0.42::DOUBLE THEN 'DOCUMENT_FRAUD_RISK_HIGH' END, CASE WHEN k % 3 = 0 THEN 'ACTIVE_LIVENESS_REQUIRED' END, CASE WHEN k % 5 = 0 THEN 'ACTIVE_LIVENESS_REPLAY_DETECTED' END, CASE WHEN k % 4 = 0 THEN 'HAND_GESTURE_REQUIRED' END,
 CASE WHEN k % 6 = 0 THEN 'FACE_MATCH_LOW' END, CASE WHEN k % 8 <> 0 AND 0.6::DOUBLE + k / 300 < 0.68::DOUBLE THEN 'FACE_MATCH_LOW' END, CASE WHEN k % 2 = 0 THEN 'PASSIVE_LIVENESS_REQUIRED' END, CASE WHEN k % 9 = 0 THEN 'CONTACT_CONFIRMATION_REQUIRED' END) AS reasons FROM steps)
 SELECT seq, reasons, CASE WHEN regexp_matches(reasons, 'FAILED|LOW|HIGH|DETECTED') THEN 'rejected' WHEN reasons = '' THEN 'passed' ELSE 'pending' END AS decision FROM r""", "steps"),
    "c13_top_signals": oracle("SELECT code, count(*) AS n FROM signals GROUP BY code ORDER BY n DESC, code LIMIT 10", "signals"),
    "b16_signal_dedupe": oracle("""--with RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY pos) AS n, min(pos) OVER (PARTITION BY doc_id, code) AS first_pos, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sev FROM signals),
 f AS (SELECT doc_id, code, n, first_pos, sev, score FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.code, o.n, o.first_pos, CASE WHEN o.sev > f.sev OR o.score > f.score THEN o.sev ELSE f.sev END, CASE WHEN o.sev > f.sev OR o.score > f.score THEN o.score ELSE f.score END
 FROM f JOIN o ON o.doc_id = f.doc_id AND o.code = f.code AND o.n = f.n + 1), l AS (SELECT doc_id, code, first_pos, arg_max(score, n) AS score FROM f GROUP BY doc_id, code, first_pos)
 SELECT doc_id, string_agg(code, '|' ORDER BY first_pos) AS codes, round(sum(score), 4) AS total FROM l GROUP BY doc_id""", "signals").replace("WITH ", "WITH RECURSIVE ", 1).replace(",  RECURSIVE o", ", o"),
    "c10_pad_models": oracle("""--with m AS (SELECT event_id, k, CAST((event_id * (83 + 6 * k)) % 101 AS DOUBLE) / 100 AS risk, greatest(CAST((event_id * (89 + 10 * k)) % 97 AS DOUBLE) / 100, 0.1::DOUBLE) AS w FROM frames, (VALUES (0), (1), (2)) v(k) WHERE (event_id + k) % 3 <> 0),
 a AS (SELECT event_id, count(*) AS n_models, count(*) FILTER (k = 0) AS np, coalesce(greatest(sum(risk * w) FILTER (k = 0) / sum(w) FILTER (k = 0), 0.9::DOUBLE * max(risk) FILTER (k = 0)), 0) AS p, coalesce(greatest(sum(risk * w) FILTER (k > 0) / sum(w) FILTER (k > 0), 0.9::DOUBLE * max(risk) FILTER (k > 0)), 0) AS c FROM m GROUP BY event_id)
 SELECT event_id, n_models, round(least(p, 1), 6) AS primary_risk, round(least(c, 1), 6) AS companion_risk, round(least(1, CASE WHEN np = 0 THEN c WHEN p >= 0.72::DOUBLE THEN greatest(p, c * 0.75::DOUBLE) WHEN p >= 0.45::DOUBLE THEN greatest(p, c * 0.55::DOUBLE) ELSE greatest(p, least(c * 0.28::DOUBLE, 0.34::DOUBLE)) END), 6) AS model_risk FROM a""", "frames"),
    "c11_selfie_frames": SELFIE + "SELECT event_id, round(q0, 6) AS quality, round(r0, 6) AS risk, passed AS selfie_passed, codes FROM sr",
}
