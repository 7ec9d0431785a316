"""Bursts of frames: votes per session, replay checks, verdicts; gestures and held challenges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.functions import signals as sg

#: Faces narrower than this share of the frame don't vote; frame codes that burst codes replace.
SMALL_FACE = 0.22
FRAME_CODES = ("PASSIVE_SPOOF_RISK_HIGH", "PAD_MODEL_SPOOF_HIGH", "SELFIE_HELD_PHONE_SCREEN", "SELFIE_POSSIBLE_HELD_PHONE_SCREEN")
HARD_LOGIN_CODES = ("SELFIE_PHONE_SCREEN_FRAME", "SELFIE_HELD_PHONE_SCREEN", "SELFIE_TABLET_SCREEN_SURFACE", "SELFIE_PRINTED_PHOTO_PAPER")


def _c(name: str) -> Column:
    return F.col(name)


def capped_frames(frames: DataFrame, most: int, key: str = "session_id", idx: str = "idx") -> DataFrame:
    return frames.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(idx))).where(_c("nth") <= most).drop("nth")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def burst_votes(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per burst: the representative frame and the votes of all frames, in one aggregation.

    The representative has the largest (quality, match, -risk), the first of equals; a risk of 0 counts as 1 there.
    """
    risk = F.when(_c("risk") == 0, 1.0).otherwise(_c("risk"))
    display = (_c("screen_frame") >= 0.42) | (_c("display_surface") >= 0.58) | (_c("paper_photo") >= 0.38)
    large = _c("face_width") >= SMALL_FACE
    best = F.max_by(F.struct("idx", "quality", "face_match", risk.alias("risk")), F.struct("quality", "face_match", (-risk).alias("r"), (-_c("idx")).alias("i")))
    count = lambda c, name: F.count_if(c).alias(name)
    out = frames.groupBy(key).agg(
        best.alias("best"), F.count("*").alias("n"), count(display, "display_like"), count(_c("held_phone") >= 0.42, "held"), count(~large, "small_faces"),
        count(large & (_c("model_risk") >= 0.72), "high_large"), count(large & (_c("model_risk") >= 0.85), "very_large"), count(_c("model_risk") >= 0.72, "high_all"), count(_c("model_risk") >= 0.85, "very_all"),
        F.max(F.when(large, _c("model_risk"))).alias("top_large"), F.max("model_risk").alias("top_all"), F.max(F.greatest("screen_frame", "display_surface", "paper_photo")).alias("top_display"),
        F.max("held_phone").alias("top_held"), F.avg("brightness").alias("mean_brightness"), F.avg("glare_ratio").alias("mean_glare"), F.max("glare_ratio").alias("top_glare"), F.max(risk).alias("top_risk"), F.avg(risk).alias("mean_risk"),
    )
    some = _c("n") > _c("small_faces")
    pick = lambda a, b: F.when(some, _c(a)).otherwise(_c(b))
    voters = F.when(some, _c("n") - _c("small_faces")).otherwise(_c("n"))
    out = out.withColumns({"voters": voters, "model_high": pick("high_large", "high_all"), "model_very": pick("very_large", "very_all"), "top_model": pick("top_large", "top_all")})
    return out.withColumns({
        "display_ratio": _ratio(_c("display_like"), _c("n")), "held_ratio": _ratio(_c("held"), _c("n")),
        "model_recurring": ((_c("model_high") >= 3) & (_ratio(_c("model_high"), _c("voters")) >= 0.4)) | (_c("model_very") >= 2),
        "too_bright": (_c("mean_brightness") >= 150) | (_c("mean_glare") >= 0.05) | (_c("top_glare") >= 0.2),
    })


def temporal_checks(frames: DataFrame, key: str = "session_id", idx: str = "idx", thumb: str = "thumb") -> DataFrame:
    """Per burst: readable frames, mean difference of neighbouring thumbnails, spread of brightness, static or not.

    A thumbnail is an array of grey values; frames without one are skipped.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    seen = frames.where(_c(thumb).isNotNull())
    before = F.lag(thumb).over(Window.partitionBy(key).orderBy(idx))
    delta = total(F.zip_with(_c(thumb), before, lambda a, b: F.abs(a - b))) / F.size(thumb)
    seen = seen.select(key, delta.alias("delta"), (total(_c(thumb)) / F.size(thumb)).alias("grey"))
    out = seen.groupBy(key).agg(F.count("*").alias("readable"), F.coalesce(F.avg("delta"), F.lit(0.0)).alias("mean_delta"), F.stddev_pop("grey").alias("grey_spread"))
    return out.withColumn("is_static", (_c("readable") >= 4) & (_c("mean_delta") < 0.55) & (_c("grey_spread") < 0.28))


def burst_verdict(votes: DataFrame, temporal: DataFrame, frame_signals: DataFrame, key: str = "session_id") -> DataFrame:
    """Per burst: signals, risk and whether it passed. frame_signals: key, idx, signals (array) of each frame."""
    packed = frame_signals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "signals"))).alias("all"))
    rows = votes.join(temporal.select(key, "is_static"), key, "left").join(packed, key, "left").withColumn("is_static", F.coalesce("is_static", F.lit(False)))
    kept = lambda s: F.filter(s, lambda x: ~x["code"].isin(*FRAME_CODES))
    none = F.array().cast(sg.TYPE)
    own = F.coalesce(F.get(F.filter("all", lambda f: f["idx"] == _c("best.idx")), F.lit(0))["signals"], none)
    strong = F.filter(F.flatten(F.transform(F.coalesce("all", F.array().cast(f"array<struct<idx:int,signals:{sg.TYPE}>>")), lambda f: f["signals"])), lambda s: (s["severity"] == "high") & ~s["code"].isin(*FRAME_CODES))
    display = _c("display_ratio") >= 0.45
    held = ((_c("held") >= 2) | (_c("held_ratio") >= 0.25)) & ((_c("top_model") >= 0.5) | (_c("top_held") >= 0.82) | display)
    rows = rows.withColumn("held_confirmed", held)
    found = sg.ladder(
        (_c("is_static"), "SELFIE_BURST_STATIC_REPLAY", "high", 0.86), (display, "SELFIE_BURST_DISPLAY_REPLAY", "high", _c("top_display")), (_c("held_confirmed"), "SELFIE_BURST_HELD_PHONE_REPLAY", "high", _c("top_held")),
        (_c("small_faces") * 2 > _c("n"), "SELFIE_BURST_FACE_TOO_SMALL", "high", 0.7), (_c("model_recurring"), "SELFIE_BURST_MODEL_SPOOF_HIGH", "high", _c("top_model")), (_c("too_bright"), "SELFIE_LIGHTING_TOO_BRIGHT", "medium", 0.4),
    )
    rows = rows.withColumn("signals", sg.dedupe(F.concat(kept(sg.dedupe(own)), found, strong)))
    high = sg.has_severity(_c("signals"), "high")
    held_down = lambda c, on: F.when(on, c).otherwise(F.least(c, F.lit(0.48)))
    level = lambda on, worth: F.when(on, worth).otherwise(0.0)
    risk = F.greatest(held_down(_c("best.risk"), high), held_down(_c("top_risk"), high), level(_c("is_static"), 0.86), level(display, 0.86), level(_c("held_confirmed"), 0.88), held_down(_c("top_model"), _c("model_recurring")))
    rows = rows.withColumn("risk", risk).withColumn("passed", ~high & (_c("risk") <= 0.5) & (_c("best.face_match") >= 0.68))
    return rows.select(key, "signals", F.round("risk", 2).alias("risk"), "passed")


def active_liveness(frames: DataFrame, max_spoof_risk: float = 0.82, key: str = "session_id") -> DataFrame:
    """Per burst of an active challenge: representative frame, high codes in order, and whether it passed."""
    r, sf, ds, pp, mr, hr = map(_c, ("risk", "screen_frame", "display_surface", "paper_photo", "model_risk", "heuristic_risk"))
    replay = (
        (sf >= 0.62) | (pp >= 0.56) | ((r >= 0.5) & (sf >= 0.42)) | ((r >= 0.5) & (pp >= 0.38)) | ((r >= 0.55) & (ds >= 0.58) & (sf >= 0.28))
        | ((r >= max_spoof_risk) & (mr >= 0.82) & (hr >= 0.24) & ((sf >= 0.28) | (pp >= 0.24) | ((ds >= 0.62) & (sf >= 0.22))))
    )
    display = (sf >= 0.45) | ((ds >= 0.58) & (sf >= 0.28)) | ((ds >= 0.62) & (sf >= 0.22) & (mr >= 0.82) & (hr >= 0.3))
    out = frames.groupBy(key).agg(
        F.max_by(F.struct("idx", "face_confidence"), F.struct(F.coalesce("face_confidence", F.lit(0.0)), -_c("idx"))).alias("best"), F.count("*").alias("n"), F.count_if("has_face").alias("usable"), F.max("face_count").alias("faces"),
        F.count_if(_c("face_width") < SMALL_FACE).alias("small"), F.bool_or(replay).alias("any_replay"), F.count_if(display).alias("displays"), F.max("risk").alias("top_risk"), F.avg("risk").alias("mean_risk"),
    )
    recurring = (_c("n") >= 3) & (_c("displays") / _c("n") >= 0.67)
    codes = sg.ladder(
        (_c("usable") == 0, "ACTIVE_LIVENESS_FACE_NOT_FOUND", "high", 0.92), (_c("best.face_confidence") < 0.82, "ACTIVE_LIVENESS_FACE_CONFIDENCE_LOW", "high", 0.86), (_c("faces") > 1, "ACTIVE_LIVENESS_MULTIPLE_FACES", "high", 0.86),
        (_c("small") * 2 > _c("n"), "ACTIVE_LIVENESS_FACE_TOO_SMALL", "high", 0.7), (_c("any_replay") | recurring, "ACTIVE_LIVENESS_REPLAY_DETECTED", "high", _c("top_risk")),
    )
    return out.withColumn("signals", codes).withColumn("passed", F.size("signals") == 0)


def replay_locked(attempts: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, seq, locked, passed): results of retries once a replay was seen, in order of seq.

    A high replay signal sticks to all later retries until one is wholly clean: passed, no signals, and the frame,
    display, paper and heuristic checks at or below 0.24, 0.6, 0.34, 0.44, a missing check counting as 1. attempts:
    key, seq, passed, replay, other_signals (count), frame, display, paper, heuristic.
    """
    rows = attempts.select(_c(key).alias("session_id"), "seq", "passed", "replay", "other_signals", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("frame", "display", "paper", "heuristic")))
    calm = (_c("frame") <= 0.24) & (_c("display") <= 0.6) & (_c("paper") <= 0.34) & (_c("heuristic") <= 0.44)
    rows = rows.withColumn("sound", F.coalesce(_c("passed") & ~_c("replay") & (_c("other_signals") == 0), F.lit(False)))
    # a replay locks, a wholly clean retry unlocks, and others leave the lock as it is: the last of these two tells
    turn = F.when(_c("replay"), True).when(_c("sound") & calm, False)
    w = Window.partitionBy("session_id").orderBy("seq")
    lock = lambda frame: F.coalesce(F.last(turn, ignorenulls=True).over(frame), F.lit(False))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    passed = F.when(lock(before), _c("sound") & calm).otherwise(_c("sound"))
    return rows.select("session_id", "seq", lock(after).alias("locked"), passed.alias("passed"))


def challenge_rollup(results: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: have all active, and all hand challenges passed, by the latest result of each."""
    last = results.groupBy(key, "challenge_id", "kind").agg(F.max_by("passed", F.struct("ts", "seq")).alias("passed"))
    all_of = lambda kind: F.coalesce(F.bool_and(F.when(_c("kind") == kind, _c("passed"))), F.lit(False))
    return last.groupBy(key).agg(all_of("active").alias("active_passed"), all_of("hand").alias("hand_passed"))


def login_bursts(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """Per face-login burst: reasons in order (empty: go on to matching), the frame that stands for it and its embedding."""
    hard_code = (_c("screen_frame") >= 0.62) | (_c("held_phone") >= 0.52) | (_c("display_surface") >= 0.58) | (_c("paper_photo") >= 0.56)
    hard = hard_code | (_c("risk") >= 0.88)
    heuristic = F.when(_c("heuristic_risk") == 0, _c("risk")).otherwise(_c("heuristic_risk"))
    live = ~hard & (heuristic < 0.62)
    candidate = _c("has_face") & (_c("face_confidence") >= 0.82) & (_c("face_count") <= 1) & live
    frame = F.struct("idx", "embedding_id", "face_confidence", *(_c(c) for c in ("screen_frame", "held_phone", "display_surface", "paper_photo", "risk", "model_risk")))
    calm = F.struct("risk", (-_c("face_confidence")).alias("c"), "idx")
    out = frames.groupBy(key).agg(
        F.max_by(frame, F.struct("face_confidence", -_c("idx"))).alias("best"), F.count_if("has_face").alias("usable"), F.max("face_count").alias("faces"), F.count("*").alias("n"), F.count_if(hard).alias("hard"),
        F.max_by(frame, F.struct("risk", -_c("idx"))).alias("worst"), F.min_by(frame, F.when(candidate, calm)).alias("live"), F.min_by(frame, calm).alias("calm"), F.count_if(candidate).alias("candidates"),
    )
    basic = F.array_compact(F.array(
        F.when(_c("usable") == 0, F.lit("FACE_LOGIN_FACE_NOT_FOUND")), F.when((_c("best.face_confidence") != 0) & (_c("best.face_confidence") < 0.82), F.lit("FACE_LOGIN_FACE_CONFIDENCE_LOW")), F.when(_c("faces") > 1, F.lit("FACE_LOGIN_MULTIPLE_FACES")),
    ))
    replay, none = _c("hard") * 2 > _c("n"), _c("candidates") == 0
    out = out.withColumns({"basic": basic, "failed": replay | none})
    chosen = F.when(F.size("basic") > 0, _c("best")).when(replay, _c("worst")).when(~none, _c("live")).otherwise(_c("calm"))
    out = out.withColumn("frame", chosen)
    f = lambda name: _c(f"frame.{name}")
    codes = F.array_compact(F.array(
        F.when(f("risk") >= 0.62, F.lit("PASSIVE_SPOOF_RISK_HIGH")), F.when(f("screen_frame") >= 0.62, F.lit(HARD_LOGIN_CODES[0])), F.when(f("held_phone") >= 0.52, F.lit(HARD_LOGIN_CODES[1])),
        F.when(f("display_surface") >= 0.58, F.lit(HARD_LOGIN_CODES[2])), F.when(f("paper_photo") >= 0.56, F.lit(HARD_LOGIN_CODES[3])), F.when(f("model_risk") >= 0.72, F.lit("PAD_MODEL_SPOOF_HIGH")),
    ))
    passive = F.concat(F.when(_c("failed"), F.array(F.lit("FACE_LOGIN_LIVENESS_FAILED"))).otherwise(F.array().cast("array<string>")), codes)
    return out.select(key, F.when(F.size("basic") > 0, _c("basic")).otherwise(passive).alias("reasons"), f("idx").alias("frame_idx"), f("embedding_id").alias("embedding_id"))


def _far(p: str, a: int, b: int) -> Column:
    x, y = (F.get(_c(p), F.lit(a))[k] - F.get(_c(p), F.lit(b))[k] for k in ("x", "y"))
    return F.sqrt(x * x + y * y)


def gestures(hands: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    """hands (21 landmarks each) with fingers, finger_count and gesture."""
    y = lambda k: F.get(_c(landmarks), F.lit(k))["y"]
    palm = F.greatest(_far(landmarks, 5, 17), F.lit(0.001))
    up = {n: y(tip) < y(mid) - 0.02 for n, tip, mid in (("index", 8, 6), ("middle", 12, 10), ("ring", 16, 14), ("pinky", 20, 18))}
    fingers = F.struct((_far(landmarks, 4, 9) > _far(landmarks, 5, 17) * 0.72).alias("thumb"), *(c.alias(n) for n, c in up.items()))
    out = hands.withColumn("fingers", fingers)
    names = ("thumb", "index", "middle", "ring", "pinky")
    out = out.withColumn("finger_count", sum((_c(f"fingers.{n}").cast("int") for n in names), F.lit(0)))
    is_ = lambda pattern: F.concat(*(_c(f"fingers.{n}").cast("int").cast("string") for n in names)).rlike(f"^{pattern}$")
    pinched = (_c("finger_count") >= 2) & (_far(landmarks, 8, 4) < palm * 0.55) & (_far(landmarks, 12, 4) < palm * 0.55) & (_far(landmarks, 16, 4) < palm * 0.55) & (_far(landmarks, 20, 4) < palm * 0.55)
    gesture = (
        F.when(pinched, "pinched_fingers").when(_far(landmarks, 4, 8) < palm * 0.38, "ok").when(is_(".1100") & (_far(landmarks, 8, 12) < palm * 0.3), "crossed_fingers").when(is_("11000"), "l_shape")
        .when(is_("10000") & (y(4) < y(0) - 0.03), "thumb_up").when(is_("10000") & (y(4) > y(0) + 0.05), "thumb_down").when(is_("11001"), "i_love_you").when(is_("10001"), "call_me").when(is_("01001"), "rock_on")
        .when(_c("finger_count") > 0, _c("finger_count").cast("string")).otherwise("fist")
    )
    return out.withColumn("gesture", gesture)


def inside_target(landmarks: str, left: Column, top: Column, size: Column) -> Column:
    """Does the middle of a hand's landmarks lie in the circle, given in percent of the picture by its centre and width?"""
    middle = lambda k: F.aggregate(_c(landmarks), F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(landmarks)
    return F.hypot(middle("x") - left / 100, middle("y") - top / 100) <= size / 200


def gesture_matches(challenge: Column) -> Column:
    """Does a row of gestures() meet the challenge?"""
    n, g, f = _c("finger_count"), _c("gesture"), lambda k: _c(f"fingers.{k}")
    return (
        F.when(challenge.isin("one", "point"), n == 1).when(challenge.isin("two", "peace", "victory"), n == 2).when(challenge == "three", n == 3).when(challenge == "four", n == 4)
        .when(challenge.isin("five", "open_palm", "high_five", "stop"), n >= 4).when(challenge == "fist", (n == 0) | (g == "fist")).when(challenge.isin("ok", "pinch", "small_ok"), g == "ok")
        .when(challenge.isin("thumb_up", "thumb_down"), (g == challenge) | (f("thumb") & (n <= 1))).when(challenge == "rock_on", g.isin("rock_on", "i_love_you") | (f("index") & f("pinky")))
        .when(challenge == "call_me", (g == "call_me") | (f("thumb") & f("pinky"))).when(challenge == "l_shape", (g == "l_shape") | (f("thumb") & f("index") & ~f("middle") & ~f("ring") & ~f("pinky"))).otherwise(g == challenge)
    )


def face_actions(faces: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    """faces (468 landmarks or more each) with blink, mouth_open, turn_left, turn_right and yaw."""
    eye = lambda a, b, top, low: _far(landmarks, top, low) / F.greatest(_far(landmarks, a, b), F.lit(0.001))
    x = lambda k: F.get(_c(landmarks), F.lit(k))["x"]
    yaw = (x(1) - (x(234) + x(454)) / 2) / F.greatest(_far(landmarks, 234, 454), F.lit(0.001))
    out = faces.withColumns({"eye_ratio": (eye(33, 133, 159, 145) + eye(362, 263, 386, 374)) / 2, "mouth_ratio": eye(61, 291, 13, 14), "yaw": yaw})
    return out.withColumns({"blink": _c("eye_ratio") < 0.18, "mouth_open": _c("mouth_ratio") > 0.23, "turn_left": _c("yaw") < -0.05, "turn_right": _c("yaw") > 0.05})


def action_matches(challenge: Column) -> Column:
    """Does a row of face_actions() meet the challenge? Others than the four are never met."""
    flags = {"blink": "blink", "open_mouth": "mouth_open", "turn_left": "turn_left", "turn_right": "turn_right"}
    met = F.lit(False)
    for name, flag in flags.items():
        met = F.when(challenge == name, _c(flag)).otherwise(met)
    return F.coalesce(met, F.lit(False))


def held_challenges(ticks: DataFrame, needed: int = 9, key: str = "session_id", order: str = "idx", match: str = "matches") -> DataFrame:
    """Per session: whether, and at which tick, the challenge was held for `needed` matching ticks in a row."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum((~_c(match)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = ticks.withColumn("island", island).withColumn("run", F.sum(_c(match).cast("int")).over(Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key).agg(F.min(F.when(_c("run") >= needed, _c(order))).alias("completed_at"), F.max("run").alias("longest")).withColumn("completed", _c("completed_at").isNotNull())
