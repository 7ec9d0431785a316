"""Queries over bursts of frames and gestures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions import signals as sg
from sealmark.operators import bursts
from sealmark.plans.bindings import bind, oracle, table


def d1_frame_cap(spark, sf):
    return bursts.capped_frames(bind(spark, sf, "frames"), 3).select("session_id", "idx", "event_id")


def _by_user(spark, sf, most=12):
    """Frames of a user as one burst, so that bursts are longer."""
    f = bind(spark, sf, "frames").withColumn("user_id", F.split("session_id", "-")[0]).drop("idx", "session_id")
    ts = table(spark, sf, "events").select("event_id", "ts")
    from pyspark.sql import Window

    f = f.join(ts, "event_id").withColumn("idx", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")).withColumnRenamed("user_id", "session_id")
    return f.where(F.col("idx") < most)


def d2_representative_frame(spark, sf):
    return bursts.burst_votes(_by_user(spark, sf)).select("session_id", F.col("best.idx").alias("idx"), F.round("best.quality", 4).alias("quality"), F.round("best.risk", 4).alias("risk"))


VOTES = ("n", "display_like", "held", "small_faces", "voters", "model_high", "model_very")


def d3_burst_votes(spark, sf):
    v = bursts.burst_votes(_by_user(spark, sf))
    return v.select("session_id", *VOTES, F.round("display_ratio", 6).alias("display_ratio"), F.round("held_ratio", 6).alias("held_ratio"), F.round("top_model", 6).alias("top_model"), "model_recurring", "too_bright")


def _thumbs(spark, sf):
    f = _by_user(spark, sf)
    grey = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (100 + F.pmod(F.col("event_id") * (i + 3), F.when(F.col("session_id").cast("long") % 3 == 0, 2).otherwise(90))).cast("double"))
    return f.select("session_id", "idx", F.when(F.col("event_id") % 13 != 0, grey).alias("thumb"))


def d4_temporal_checks(spark, sf):
    return bursts.temporal_checks(_thumbs(spark, sf)).select("session_id", "readable", F.round("mean_delta", 6).alias("mean_delta"), F.round("grey_spread", 6).alias("grey_spread"), "is_static")


def _signals(spark, sf):
    f = _by_user(spark, sf)
    e, found = F.col("event_id"), sg.ladder
    return f.select("session_id", "idx", found(
        (e % 4 == 0, "PASSIVE_SPOOF_RISK_HIGH", "high", 0.7), (e % 5 == 0, "SELFIE_SCREEN_GLARE", "medium", 0.3), (e % 6 == 0, "SELFIE_HELD_PHONE_SCREEN", "high", 0.6),
        (e % 37 == 0, "SELFIE_PRINTED_PHOTO_PAPER", "high", F.col("paper_photo")), (e % 7 == 0, "SELFIE_LOW_SHARPNESS", "medium", 0.28),
    ).alias("signals"))


def d5_burst_verdict(spark, sf):
    out = bursts.burst_verdict(bursts.burst_votes(_by_user(spark, sf)), bursts.temporal_checks(_thumbs(spark, sf)), _signals(spark, sf))
    return out.select("session_id", sg.codes(F.col("signals")).alias("codes"), "risk", "passed")


def d6_active_liveness(spark, sf):
    out = bursts.active_liveness(_by_user(spark, sf, 6))
    return out.select("session_id", F.col("best.idx").alias("idx"), sg.codes(F.col("signals")).alias("codes"), F.round("top_risk", 6).alias("top_risk"), F.round("mean_risk", 6).alias("mean_risk"), "passed")


def retries(s):
    """Liveness attempts from steps."""
    k = F.col("k")
    clean = F.when(k % 3 == 0, 0.1).when(k % 3 == 1, 0.5)
    return s.select(F.col("user_id").alias("session_id"), "seq", (k % 4 != 0).alias("passed"), (k % 9 == 0).alias("replay"), F.when(k % 5 == 0, 1).otherwise(0).alias("other_signals"), *(clean.alias(c) for c in ("frame", "display", "paper", "heuristic")))


def d7_replay_lock(spark, sf):
    return bursts.replay_locked(retries(bind(spark, sf, "steps")))


def d8_challenge_rollup(spark, sf):
    s = bind(spark, sf, "steps")
    rows = s.select(F.col("user_id").alias("session_id"), "seq", "ts", F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("challenge_id"), F.when(F.col("k") % 4 < 2, "active").otherwise("hand").alias("kind"), (F.col("value") < 60).alias("passed"))
    return bursts.challenge_rollup(rows)


def d9_login_burst(spark, sf):
    f = _by_user(spark, sf, 3).withColumn("embedding_id", F.col("event_id"))
    return bursts.login_bursts(f).select("session_id", F.concat_ws("|", "reasons").alias("reasons"), "frame_idx")


def _hands(spark, sf):
    """21 points from arithmetic on the event id."""
    e = table(spark, sf, "events").select("event_id")
    point = lambda i: F.struct((F.pmod(F.col("event_id") * (i * 7 + 3), F.lit(101)) / 100.0).alias("x"), (F.pmod(F.col("event_id") * (i * 5 + 11), F.lit(97)) / 100.0).alias("y"))
    return e.withColumn("landmarks", F.transform(F.sequence(F.lit(0), F.lit(20)), point))


CHALLENGES = ("one", "peace", "three", "four", "stop", "fist", "ok", "thumb_up", "rock_on", "call_me", "l_shape", "crossed_fingers")


def d10_gestures(spark, sf):
    challenge = F.element_at(F.array(*map(F.lit, CHALLENGES)), (F.col("event_id") % len(CHALLENGES) + 1).cast("int"))
    k = F.col("event_id")
    inside = bursts.inside_target("landmarks", k % 100, k * 3 % 100, k % 80)
    return bursts.gestures(_hands(spark, sf)).select("event_id", "finger_count", "gesture", bursts.gesture_matches(challenge).alias("matches"), inside.alias("inside"))


def d11_face_actions(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    point = lambda i: F.struct((F.pmod(F.col("event_id") * (i % 13 + 3) + i, F.lit(101)) / 100.0).alias("x"), (F.pmod(F.col("event_id") * (i % 11 + 5) + i, F.lit(97)) / 100.0).alias("y"))
    faces = e.withColumn("landmarks", F.transform(F.sequence(F.lit(0), F.lit(467)), point))
    challenge = F.element_at(F.array(*map(F.lit, ("blink", "open_mouth", "turn_left", "turn_right", "nod"))), (F.col("event_id") % 5 + 1).cast("int"))
    return bursts.face_actions(faces).withColumn("matches", bursts.action_matches(challenge)).select("matches", "event_id", F.round("eye_ratio", 6).alias("eye_ratio"), F.round("mouth_ratio", 6).alias("mouth_ratio"), F.round("yaw", 6).alias("yaw"), "blink", "mouth_open", "turn_left", "turn_right")


def d12_held_challenge(spark, sf):
    s = bind(spark, sf, "steps").select(F.col("user_id").alias("session_id"), F.col("seq").alias("idx"), (F.col("k") % 6 != 0).alias("matches"))
    return bursts.held_challenges(s)


QUERIES = [d1_frame_cap, d2_representative_frame, d3_burst_votes, d4_temporal_checks, d5_burst_verdict, d6_active_liveness, d7_replay_lock, d8_challenge_rollup, d9_login_burst, d10_gestures, d11_face_actions, d12_held_challenge]

USERS = """--with u AS (SELECT * EXCLUDE (idx, session_id), split_part(session_id, '-', 1) AS session_id FROM frames), b AS (SELECT u.*, CAST(row_number() OVER (PARTITION BY u.session_id ORDER BY e.ts, u.event_id) - 1 AS INT) AS idx, CASE WHEN risk = 0 THEN 1 ELSE risk END AS r1 FROM u JOIN events e USING (event_id) QUALIFY idx < {0})
"""
V = USERS.format(12) + """, v0 AS (SELECT session_id, arg_max(idx, (quality, face_match, -r1, -idx)) AS best, arg_max(r1, (quality, face_match, -r1, -idx)) AS best_risk, arg_max(face_match, (quality, face_match, -r1, -idx)) AS best_match, max(quality) AS best_quality, count(*) AS n,
 count(*) FILTER (screen_frame >= 0.42::DOUBLE OR display_surface >= 0.58::DOUBLE OR paper_photo >= 0.38::DOUBLE) AS display_like, count(*) FILTER (held_phone >= 0.42::DOUBLE) AS held, count(*) FILTER (face_width < 0.22::DOUBLE) AS small_faces, bool_or(face_width >= 0.22::DOUBLE) AS any_large,
 max(r1) AS top_risk, avg(brightness) AS mb, avg(glare_ratio) AS mg, max(glare_ratio) AS tg, max(greatest(screen_frame, display_surface, paper_photo)) AS top_display, max(held_phone) AS top_held FROM b GROUP BY session_id),
 m0 AS (SELECT b.session_id, count(*) AS voters, count(*) FILTER (model_risk >= 0.72::DOUBLE) AS model_high, count(*) FILTER (model_risk >= 0.85::DOUBLE) AS model_very, max(model_risk) AS top_model FROM b JOIN v0 USING (session_id) WHERE NOT any_large OR face_width >= 0.22::DOUBLE GROUP BY b.session_id),
 v AS (SELECT *, display_like / n AS display_ratio, held / n AS held_ratio, (model_high >= 3 AND model_high / voters >= 0.4::DOUBLE) OR model_very >= 2 AS model_recurring, mb >= 150 OR mg >= 0.05::DOUBLE OR tg >= 0.2::DOUBLE AS too_bright FROM v0 JOIN m0 USING (session_id))
"""
T = """, th AS (SELECT session_id, idx, [CAST(100 + (event_id * (i + 3)) % (CASE WHEN session_id::BIGINT % 3 = 0 THEN 2 ELSE 90 END) AS DOUBLE) for i in range(8)] AS t FROM b WHERE event_id % 13 <> 0),
 dl AS (SELECT session_id, list_sum(t) / 8 AS grey, lag(t) OVER (PARTITION BY session_id ORDER BY idx) AS p, t FROM th),
 tc AS (SELECT session_id, count(*) AS readable, coalesce(avg(list_sum([abs(t[i] - p[i]) for i in range(1, 9)]) / 8) FILTER (p IS NOT NULL), 0) AS mean_delta, stddev_pop(grey) AS grey_spread FROM dl GROUP BY session_id),
 tt AS (SELECT *, readable >= 4 AND mean_delta < 0.55::DOUBLE AND grey_spread < 0.28::DOUBLE AS is_static FROM tc)
"""


def login_sql(frames: str, key: str) -> str:
    """CTE `login` (session, reasons as a list, frame_idx, free) of the bursts in `frames`."""
    return f"""lf AS (SELECT *, {key} AS session, screen_frame >= 0.62::DOUBLE OR held_phone >= 0.52::DOUBLE OR display_surface >= 0.58::DOUBLE OR paper_photo >= 0.56::DOUBLE OR risk >= 0.88::DOUBLE AS hard FROM {frames}),
 lc AS (SELECT *, has_face AND face_confidence >= 0.82::DOUBLE AND face_count <= 1 AND NOT hard AND CASE WHEN heuristic_risk = 0 THEN risk ELSE heuristic_risk END < 0.62::DOUBLE AS good FROM lf),
 la AS (SELECT session, arg_max(idx, (face_confidence, -idx)) AS best, max(face_confidence) AS conf, count(*) FILTER (has_face) AS usable, max(face_count) AS faces, count(*) AS n, count(*) FILTER (hard) AS n_hard,
  arg_max(idx, (risk, -idx)) AS worst, arg_min(idx, (risk, -face_confidence, idx)) FILTER (good) AS live, arg_min(idx, (risk, -face_confidence, idx)) AS calm FROM lc GROUP BY session),
 lb AS (SELECT *, list_filter([CASE WHEN usable = 0 THEN 'FACE_LOGIN_FACE_NOT_FOUND' END, CASE WHEN conf <> 0 AND conf < 0.82::DOUBLE THEN 'FACE_LOGIN_FACE_CONFIDENCE_LOW' END, CASE WHEN faces > 1 THEN 'FACE_LOGIN_MULTIPLE_FACES' END], lambda x: x IS NOT NULL) AS basic,
  n_hard * 2 > n AS replay FROM la),
 li AS (SELECT *, CASE WHEN len(basic) > 0 THEN best WHEN replay THEN worst WHEN live IS NOT NULL THEN live ELSE calm END AS frame_idx FROM lb),
 login AS (SELECT li.session, li.frame_idx, lc.event_id, CASE WHEN len(basic) > 0 THEN basic ELSE list_filter([CASE WHEN replay OR live IS NULL THEN 'FACE_LOGIN_LIVENESS_FAILED' END, CASE WHEN risk >= 0.62::DOUBLE THEN 'PASSIVE_SPOOF_RISK_HIGH' END,
  CASE WHEN screen_frame >= 0.62::DOUBLE THEN 'SELFIE_PHONE_SCREEN_FRAME' END, CASE WHEN held_phone >= 0.52::DOUBLE THEN 'SELFIE_HELD_PHONE_SCREEN' END, CASE WHEN display_surface >= 0.58::DOUBLE THEN 'SELFIE_TABLET_SCREEN_SURFACE' END,
  CASE WHEN paper_photo >= 0.56::DOUBLE THEN 'SELFIE_PRINTED_PHOTO_PAPER' END, CASE WHEN model_risk >= 0.72::DOUBLE THEN 'PAD_MODEL_SPOOF_HIGH' END], lambda x: x IS NOT NULL) END AS reasons FROM li JOIN lc ON lc.session = li.session AND lc.idx = li.frame_idx)"""


def _points(x: str, y: str, which) -> str:
    """Columns x0, y0 .. of the landmarks that a query looks at; texts with {i} give a point's numbers modulo 101 and 97."""
    return ", ".join(f"CAST(({x.format(i=i)}) % 101 AS DOUBLE) / 100 AS x{i}, CAST(({y.format(i=i)}) % 97 AS DOUBLE) / 100 AS y{i}" for i in which)


def _apart(a: int, b: int) -> str:
    return f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"


_PALM = f"greatest({_apart(5, 17)}, 0.001::DOUBLE)"
_UP = ", ".join(f"y{tip} < y{mid} - 0.02::DOUBLE AS {n}" for n, tip, mid in (("f1", 8, 6), ("f2", 12, 10), ("f3", 16, 14), ("f4", 20, 18)))
_NEAR = " AND ".join(f"{_apart(k, 4)} < {_PALM} * 0.55::DOUBLE" for k in (8, 12, 16, 20))
GESTURES = f"""WITH p AS (SELECT event_id, {_points("event_id * ({i} * 7 + 3)", "event_id * ({i} * 5 + 11)", range(21))} FROM events), f AS (SELECT *, {_apart(4, 9)} > {_apart(5, 17)} * 0.72::DOUBLE AS f0, {_UP} FROM p),
 n AS (SELECT *, f0::INT + f1::INT + f2::INT + f3::INT + f4::INT AS n, concat(f0::INT, f1::INT, f2::INT, f3::INT, f4::INT) AS m FROM f),
 g AS (SELECT *, CASE WHEN n >= 2 AND {_NEAR} THEN 'pinched_fingers' WHEN {_apart(4, 8)} < {_PALM} * 0.38::DOUBLE THEN 'ok' WHEN substr(m, 2) = '1100' AND {_apart(8, 12)} < {_PALM} * 0.3::DOUBLE THEN 'crossed_fingers' WHEN m = '11000' THEN 'l_shape'
  WHEN m = '10000' AND y4 < y0 - 0.03::DOUBLE THEN 'thumb_up' WHEN m = '10000' AND y4 > y0 + 0.05::DOUBLE THEN 'thumb_down' WHEN m = '11001' THEN 'i_love_you' WHEN m = '10001' THEN 'call_me' WHEN m = '01001' THEN 'rock_on' WHEN n > 0 THEN n::VARCHAR ELSE 'fist' END AS g,
  {list(CHALLENGES)}[event_id % {len(CHALLENGES)} + 1] AS c FROM n)
"""
_EYE = "{} / greatest({}, 0.001::DOUBLE)"
SQL = {
    "d9_login_burst": oracle(USERS.format(3) + ", " + login_sql("b", "session_id") + " SELECT session AS session_id, array_to_string(reasons, '|') AS reasons, frame_idx FROM login", "frames"),
    "d10_gestures": GESTURES + """SELECT event_id, n AS finger_count, g AS gesture, CASE c WHEN 'one' THEN n = 1 WHEN 'peace' THEN n = 2 WHEN 'three' THEN n = 3 WHEN 'four' THEN n = 4 WHEN 'stop' THEN n >= 4 WHEN 'fist' THEN n = 0 OR g = 'fist' WHEN 'ok' THEN g = 'ok'
 WHEN 'thumb_up' THEN g = c OR (f0 AND n <= 1) WHEN 'rock_on' THEN g IN ('rock_on', 'i_love_you') OR (f1 AND f4) WHEN 'call_me' THEN g = 'call_me' OR (f0 AND f4) WHEN 'l_shape' THEN g = 'l_shape' OR (f0 AND f1 AND NOT f2 AND NOT f3 AND NOT f4) ELSE g = c END AS matches,
 sqrt(pow(list_sum([(event_id * (i * 7 + 3) % 101) / 100.0::DOUBLE for i in range(21)]) / 21 - (event_id % 100) / 100.0::DOUBLE, 2) + pow(list_sum([(event_id * (i * 5 + 11) % 97) / 100.0::DOUBLE for i in range(21)]) / 21 - (event_id * 3 % 100) / 100.0::DOUBLE, 2)) <= (event_id % 80) / 200.0::DOUBLE AS inside FROM g""",
    "d11_face_actions": f"""WITH p AS (SELECT event_id, {_points("event_id * ({i} % 13 + 3) + {i}", "event_id * ({i} % 11 + 5) + {i}", (1, 13, 14, 33, 61, 133, 145, 159, 234, 263, 291, 362, 374, 386, 454))} FROM events),
 m AS (SELECT event_id, ({_EYE.format(_apart(159, 145), _apart(33, 133))} + {_EYE.format(_apart(386, 374), _apart(362, 263))}) / 2 AS e, {_EYE.format(_apart(13, 14), _apart(61, 291))} AS o, (x1 - (x234 + x454) / 2) / greatest({_apart(234, 454)}, 0.001::DOUBLE) AS w FROM p)
 SELECT event_id, [e < 0.18::DOUBLE, o > 0.23::DOUBLE, w < -0.05::DOUBLE, w > 0.05::DOUBLE, false][event_id % 5 + 1] AS matches, round(e, 6) AS eye_ratio, round(o, 6) AS mouth_ratio, round(w, 6) AS yaw, e < 0.18::DOUBLE AS blink, o > 0.23::DOUBLE AS mouth_open, w < -0.05::DOUBLE AS turn_left, w > 0.05::DOUBLE AS turn_right FROM m""",
    "d1_frame_cap": oracle("SELECT session_id, idx, event_id FROM frames WHERE idx < 3", "frames"),
    "d2_representative_frame": oracle(V + "SELECT session_id, best AS idx, round(best_quality, 4) AS quality, round(best_risk, 4) AS risk FROM v", "frames"),
    "d3_burst_votes": oracle(V + "SELECT session_id, n, display_like, held, small_faces, voters, model_high, model_very, round(display_ratio, 6) AS display_ratio, round(held_ratio, 6) AS held_ratio, round(top_model, 6) AS top_model, model_recurring, too_bright FROM v", "frames"),
    "d4_temporal_checks": oracle(USERS.format(12) + T + "SELECT session_id, readable, round(mean_delta, 6) AS mean_delta, round(grey_spread, 6) AS grey_spread, is_static FROM tt", "frames"),
    "d5_burst_verdict": oracle(V + T + """, w AS (SELECT v.*, coalesce(is_static, false) AS st, display_ratio >= 0.45::DOUBLE AS dp, (held >= 2 OR held_ratio >= 0.25::DOUBLE) AND (top_model >= 0.5::DOUBLE OR top_held >= 0.82::DOUBLE OR display_ratio >= 0.45::DOUBLE) AS hp FROM v LEFT JOIN tt USING (session_id)),
 own AS (SELECT b.session_id, b.event_id FROM b JOIN w ON w.session_id = b.session_id AND w.best = b.idx),
 print AS (SELECT session_id, count(*) FILTER (event_id % 37 = 0) AS n_print FROM b GROUP BY session_id),
 c AS (SELECT w.*, o.event_id % 5 = 0 AS glare, o.event_id % 37 = 0 AS own_print, o.event_id % 7 = 0 AS sharp, n_print > 0 AS any_print FROM w JOIN own o USING (session_id) JOIN print USING (session_id)),
 h AS (SELECT *, st OR dp OR hp OR small_faces * 2 > n OR model_recurring OR any_print AS high FROM c),
 r AS (SELECT *, greatest(CASE WHEN high THEN best_risk ELSE least(best_risk, 0.48::DOUBLE) END, CASE WHEN high THEN top_risk ELSE least(top_risk, 0.48::DOUBLE) END, CASE WHEN st THEN 0.86::DOUBLE ELSE 0 END, CASE WHEN dp THEN 0.86::DOUBLE ELSE 0 END, CASE WHEN hp THEN 0.88::DOUBLE ELSE 0 END, CASE WHEN model_recurring THEN top_model ELSE least(top_model, 0.48::DOUBLE) END) AS risk FROM h)
 SELECT session_id, concat_ws('|', CASE WHEN glare THEN 'SELFIE_SCREEN_GLARE' END, CASE WHEN own_print THEN 'SELFIE_PRINTED_PHOTO_PAPER' END, CASE WHEN sharp THEN 'SELFIE_LOW_SHARPNESS' END, CASE WHEN st THEN 'SELFIE_BURST_STATIC_REPLAY' END, CASE WHEN dp THEN 'SELFIE_BURST_DISPLAY_REPLAY' END, CASE WHEN hp THEN 'SELFIE_BURST_HELD_PHONE_REPLAY' END,
  CASE WHEN small_faces * 2 > n THEN 'SELFIE_BURST_FACE_TOO_SMALL' END, CASE WHEN model_recurring THEN 'SELFIE_BURST_MODEL_SPOOF_HIGH' END, CASE WHEN too_bright THEN 'SELFIE_LIGHTING_TOO_BRIGHT' END, CASE WHEN any_print AND NOT own_print THEN 'SELFIE_PRINTED_PHOTO_PAPER' END) AS codes,
  round(risk, 2) AS risk, NOT high AND risk <= 0.5::DOUBLE AND best_match >= 0.68::DOUBLE AS passed FROM r""", "frames"),
    "d6_active_liveness": oracle(USERS.format(6) + """, a AS (SELECT session_id, arg_max(idx, (face_confidence, -idx)) AS idx, max(face_confidence) AS conf, count(*) AS n, count(*) FILTER (has_face) AS usable, max(face_count) AS faces, count(*) FILTER (face_width < 0.22::DOUBLE) AS small, max(risk) AS top_risk, avg(risk) AS mean_risk,
 bool_or(screen_frame >= 0.62::DOUBLE OR paper_photo >= 0.56::DOUBLE OR (risk >= 0.5::DOUBLE AND screen_frame >= 0.42::DOUBLE) OR (risk >= 0.5::DOUBLE AND paper_photo >= 0.38::DOUBLE) OR (risk >= 0.55::DOUBLE AND display_surface >= 0.58::DOUBLE AND screen_frame >= 0.28::DOUBLE)
  OR (risk >= 0.82::DOUBLE AND model_risk >= 0.82::DOUBLE AND heuristic_risk >= 0.24::DOUBLE AND (screen_frame >= 0.28::DOUBLE OR paper_photo >= 0.24::DOUBLE OR (display_surface >= 0.62::DOUBLE AND screen_frame >= 0.22::DOUBLE)))) AS rep,
 count(*) FILTER (screen_frame >= 0.45::DOUBLE OR (display_surface >= 0.58::DOUBLE AND screen_frame >= 0.28::DOUBLE) OR (display_surface >= 0.62::DOUBLE AND screen_frame >= 0.22::DOUBLE AND model_risk >= 0.82::DOUBLE AND heuristic_risk >= 0.3::DOUBLE)) AS disp FROM b GROUP BY session_id)
 SELECT session_id, idx, concat_ws('|', CASE WHEN usable = 0 THEN 'ACTIVE_LIVENESS_FACE_NOT_FOUND' END, CASE WHEN conf < 0.82::DOUBLE THEN 'ACTIVE_LIVENESS_FACE_CONFIDENCE_LOW' END, CASE WHEN faces > 1 THEN 'ACTIVE_LIVENESS_MULTIPLE_FACES' END, CASE WHEN small * 2 > n THEN 'ACTIVE_LIVENESS_FACE_TOO_SMALL' END, CASE WHEN rep OR (n >= 3 AND disp / n >= 0.67::DOUBLE) THEN 'ACTIVE_LIVENESS_REPLAY_DETECTED' END) AS codes,
 round(top_risk, 6) AS top_risk, round(mean_risk, 6) AS mean_risk, NOT (usable = 0 OR conf < 0.82::DOUBLE OR faces > 1 OR small * 2 > n OR rep OR (n >= 3 AND disp / n >= 0.67::DOUBLE)) AS passed FROM a""", "frames"),
    "d7_replay_lock": oracle("""--with o AS (SELECT user_id AS session_id, seq, k, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n, k % 9 = 0 AS replay, k % 4 <> 0 AND k % 9 <> 0 AND k % 5 <> 0 AS ok FROM steps),
 f AS (SELECT session_id, seq, n, replay AS locked, ok AS passed FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.seq, o.n, CASE WHEN f.locked THEN NOT (o.ok AND o.k % 3 = 0) ELSE o.replay END, CASE WHEN f.locked THEN o.ok AND o.k % 3 = 0 ELSE o.ok END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
 SELECT session_id, seq, locked, passed FROM f""", "steps").replace("WITH ", "WITH RECURSIVE ", 1),
    "d8_challenge_rollup": oracle("""--with l AS (SELECT user_id AS session_id, k % 4 AS ch, arg_max(value < 60, (ts, seq)) AS passed FROM steps GROUP BY user_id, k % 4)
 SELECT session_id, coalesce(bool_and(passed) FILTER (ch < 2), false) AS active_passed, coalesce(bool_and(passed) FILTER (ch >= 2), false) AS hand_passed FROM l GROUP BY session_id""", "steps"),
    "d12_held_challenge": oracle("""--with t AS (SELECT user_id AS session_id, seq, k % 6 <> 0 AS m, sum(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isl FROM steps),
 r AS (SELECT *, CAST(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, isl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM t)
 SELECT session_id, min(seq) FILTER (run >= 9) AS completed_at, max(run) AS longest, bool_or(run >= 9) AS completed FROM r GROUP BY session_id""", "steps"),
}
