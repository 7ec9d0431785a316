"""Scores, bursts, throttles, matching, audit, documents and columns on small frames."""

import datetime as dt
import hashlib
import hmac
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealmark.functions import crypto, scalars
from sealmark.functions import signals as sg
from sealmark.operators import audit, bursts, matching, metrics, scoring, throttle, zones

SPECIMEN = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
INVENTED = "P<UTOSAMPLESON<<ALEX<KIM<<<<<<<<<<<<<<<<<<<<\nTS00123450UTO9001158F3506307<<<<<<<<<<<<<<<2"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_masks(spark):
    number = lambda v: one(spark, scalars.mask_document_number(F.lit(v)))[0]
    contact = lambda v: one(spark, scalars.mask_contact(F.lit(v)))[0]
    assert [number(v) for v in ("AB1234567", "AB12", "", " AB123 ")] == ["AB•••••67", "••••", "", "AB•23"] and number(None) is None
    assert [contact(v) for v in ("x@y.com", "+85620555123", "123", "@y", "a@b@c")] == ["x***@y.com", "***5123", "***", "***@y", "a***@b@c"]


def test_names_ages_dates(spark):
    r = one(spark, scalars.split_name(F.lit("ANNA<maria o'neil-smith")).alias("a"), scalars.split_name(F.lit("solo")).alias("b"), scalars.split_name(F.lit(" < ")).alias("c"))
    assert tuple(r.a) == ("Anna Maria", "O'Neil-Smith") and tuple(r.b) == ("Solo", None) and tuple(r.c) == (None, None)
    age = lambda b, d: one(spark, scalars.age_at(F.lit(b), F.lit(d)))[0]
    assert age(dt.date(2000, 2, 29), dt.date(2024, 2, 28)) == 23 and age(dt.date(2000, 2, 29), dt.date(2024, 2, 29)) == 24
    day = lambda t: one(spark, scalars.loose_date(F.lit(t)))[0]
    assert [day(t) for t in ("03 MAR 1990", "1990-05-05", "31 FEB 2000", "no", "12 1999", "7/25/2001")] == [dt.date(1990, 3, 3), dt.date(1990, 5, 5), None, None, dt.date(1999, 12, 12), dt.date(2001, 7, 25)]


def test_keyed_columns(spark):
    r = one(spark, scalars.blind_index(F.lit(" ab1 "), b"k").alias("i"), scalars.blind_index(F.lit("AB1"), b"k").alias("j"), scalars.hmac_sha256(b"x" * 100, F.lit("é")).alias("h"), scalars.blind_index(F.lit(None).cast("string"), b"k").alias("n"))
    assert r.i == r.j == hmac.new(hashlib.sha256(b"k|blind-index").digest(), b"AB1", "sha256").hexdigest() and r.n is None
    assert r.h == hmac.new(b"x" * 100, "é".encode(), "sha256").hexdigest()
    df = spark.range(1).select(crypto.encrypt(F.lit("pii"), b"a").alias("v"), crypto.encrypt(F.lit("pii"), b"a").alias("w"), crypto.encrypt(F.lit(None).cast("string"), b"a").alias("n"))
    df = spark.createDataFrame(df.collect(), df.schema)
    r = df.select("v", "w", "n", crypto.decrypt(F.col("v"), b"b", b"a").alias("ok"), crypto.decrypt(F.col("v"), b"b").alias("no"), crypto.decrypt(F.lit("plain"), b"b").alias("old")).first()
    assert r.v != r.w and r.v.startswith("enc:v1:") and r.n is None and (r.ok, r.no, r.old) == ("pii", None, "plain")
    turned = crypto.rotate(df, "v", b"new", b"a").first().v
    assert one(spark, crypto.decrypt(F.lit(turned), b"new"))[0] == "pii" and crypto.rotate(df, "v", b"a", b"old").first().v == r.v


def test_signal_fold(spark):
    row = lambda code, sev, score: F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(score).alias("score"))
    got = one(spark, sg.dedupe(F.array(row("A", "high", 0.3), row("B", "low", 0.1), row("A", "low", 0.5))))[0]
    assert [tuple(s) for s in got] == [("A", "low", 0.5), ("B", "low", 0.1)]


def test_family_score_and_missing_families(spark):
    rows = [(1, "tamper", "m", 0.8, 0.5, "available"), (1, "tamper", "m", 0.2, 0.5, "available"), (2, "tamper", "m", 0.9, 0.9, "failed")]
    got = {r.doc_id: r for r in scoring.document_ensemble(spark.createDataFrame(rows, "doc_id long, family string, model_id string, score double, confidence double, status string")).collect()}
    assert got[1].tamper == pytest.approx(0.72) and got[1].recapture == 0 and (got[2].tamper, got[2].fraud, got[2].confidence) == (0, 0, 0)


def decide(spark, **changes):
    base = {"document_status": "passed", "fraud_risk_score": 0.1, "active_passed": True, "hand_passed": True, "face_match_score": 0.9, "passive_passed": True, "contact_confirmed": True} | changes
    none = F.array().cast(sg.TYPE)
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in base.items()), *(none.alias(c) for c in ("document_signals", "active_signals", "selfie_signals")))
    r = scoring.decide(df, contact_required=True).first()
    return r.decision, list(r.reason_codes)


def test_decision_thresholds(spark):
    assert decide(spark) == ("passed", [])
    assert decide(spark, passive_passed=False) == ("pending", ["PASSIVE_LIVENESS_REQUIRED"])
    assert decide(spark, face_match_score=0.0)[0] == "passed" and decide(spark, face_match_score=0.68)[0] == "passed"
    assert decide(spark, face_match_score=0.67) == ("rejected", ["FACE_MATCH_LOW"])
    assert decide(spark, fraud_risk_score=0.42)[0] == "passed" and decide(spark, fraud_risk_score=0.43)[0] == "rejected"
    assert decide(spark, contact_confirmed=False) == ("pending", ["CONTACT_CONFIRMATION_REQUIRED"])


def test_limiter():
    seconds = np.array([0, 10, 20, 60, 61, 70]) * 1_000_000
    assert throttle.admitted(seconds, 60_000_000, 2).tolist() == [True, True, False, False, True, False]
    assert throttle.admitted(seconds, 60_000_000, 0).all()
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(0, 10**9, 3000))
    kept = t[throttle.admitted(t, 10**7, 5)]
    assert all(((kept >= x - 10**7) & (kept <= x)).sum() <= 5 for x in kept)


def test_one_time_codes(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", 1, t(0), "issue", "1"), ("a", 2, t(11), "confirm", "1"), ("a", 3, t(12), "confirm", "1"), ("b", 4, t(0), "issue", "1"), ("b", 5, t(1), "confirm", "x"), ("b", 6, t(2), "confirm", "y"), ("b", 7, t(3), "confirm", "1"),
            ("c", 8, t(0), "confirm", "1"), ("c", 9, t(1), "issue", "1"), ("c", 10, t(2), "confirm", "1"), ("c", 11, t(3), "confirm", "1")]
    got = {r.seq: r.outcome for r in throttle.code_outcomes(spark.createDataFrame(rows, "session_id string, seq long, ts timestamp, kind string, code string"), 600, 2).collect()}
    assert got == {2: "CODE_EXPIRED", 3: "NO_CONTACT_CHALLENGE", 5: "CODE_INVALID", 6: "CODE_INVALID", 7: "TOO_MANY_ATTEMPTS", 8: "NO_CONTACT_CHALLENGE", 10: "OK", 11: "CODE_ALREADY_USED"}


def test_replay_lock(spark):
    rows = [("s", 1, True, True, 0, 0.1, 0.1, 0.1, 0.1), ("s", 2, True, False, 0, 0.1, 0.1, None, 0.1), ("s", 3, True, False, 1, 0.1, 0.1, 0.1, 0.1), ("s", 4, True, False, 0, 0.24, 0.6, 0.34, 0.44), ("s", 5, True, False, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "session_id string, seq long, passed boolean, replay boolean, other_signals int, frame double, display double, paper double, heuristic double")
    assert [(r.locked, r.passed) for r in bursts.replay_locked(df).orderBy("seq").collect()] == [(True, False), (True, False), (True, False), (False, True), (False, True)]


def test_held_challenge_resets(spark):
    rows = [("a", i, i != 5) for i in range(15)] + [("b", i, True) for i in range(8)]
    got = {r.session_id: (r.completed, r.completed_at) for r in bursts.held_challenges(spark.createDataFrame(rows, "session_id string, idx int, matches boolean")).collect()}
    assert got == {"a": (True, 14), "b": (False, None)}


def test_gestures(spark):
    flat = [[0.5, 0.9]] * 21
    fist = [list(p) for p in flat]
    fist[5], fist[17], fist[4], fist[9] = [0.4, 0.6], [0.6, 0.6], [0.5, 0.6], [0.5, 0.62]
    for tip, mid in ((8, 6), (12, 10), (16, 14), (20, 18)):
        fist[tip], fist[mid] = [0.5, 0.8], [0.5, 0.7]
    five = [list(p) for p in fist]
    five[4] = [0.2, 0.5]
    for n, (tip, mid) in enumerate(((8, 6), (12, 10), (16, 14), (20, 18))):
        five[tip], five[mid] = [0.4 + n / 10, 0.2], [0.4 + n / 10, 0.5]
    df = spark.createDataFrame([(k, [tuple(p) for p in v]) for k, v in (("fist", fist), ("five", five))], "name string, landmarks array<struct<x:double,y:double>>")
    got = {r.name: (r.finger_count, r.gesture, r.m) for r in bursts.gestures(df).withColumn("m", bursts.gesture_matches(F.col("name"))).collect()}
    assert got == {"fist": (0, "fist", True), "five": (5, "5", True)}


def test_matching(spark):
    score = lambda a, b: one(spark, matching.match_score(F.lit(a) if a is not None else F.lit(None).cast("array<double>"), F.lit(b)))[0]
    assert [score(a, [1.0, 0.0]) for a in ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [1.0], None)] == [1.0, 0.5, 0.0, 0.0, 0.0]
    gallery = spark.createDataFrame([("f2", True, [1.0, 0.0]), ("f1", True, [1.0, 0.0]), ("f0", False, [1.0, 0.0]), ("f3", True, None)], "face_id string, active boolean, embedding array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-0.16, 0.987]), (3, None), (4, [0.44, 0.898])], "probe_id long, embedding array<double>")
    got = {r.probe_id: (r.face_id, r.score) for r in matching.identify(probes, gallery).collect()}
    assert got == {1: ("f1", 1.0), 2: (None, 0.42), 3: (None, 0.0), 4: ("f1", 0.72)}
    assert {r.face_id for r in matching.identify(probes, gallery.limit(0)).collect()} == {None}


def test_template_protection(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, None)], "i long, embedding array<double>")
    a, b = ({r.i: r.embedding for r in matching.protect_templates(df, k).collect()} for k in (b"one", b"two"))
    ya, yb = (np.array([v[i] for i in range(6)]) for v in (a, b))
    assert np.abs(ya @ ya.T - x @ x.T).max() < 1e-9 and np.abs((ya * yb).sum(1)).max() < 0.9 and a[9] is None
    assert matching.protect_templates(df, None) is df


def test_error_rates(spark):
    rows = [("genuine", s) for s in (0.6, 0.7, 0.8, 0.9)] + [("impostor", s) for s in (0.3, 0.5, 0.64, 0.66)]
    df = spark.createDataFrame(rows, "pair string, score double")
    sweep = metrics.threshold_sweep(df)
    by = {round(r.threshold, 2): (r.far, r.frr) for r in sweep.collect()}
    assert len(by) == 38 and by[0.64] == (0.5, 0.25) and by[0.66] == (0.25, 0.25) and by[0.68] == (0.0, 0.25)
    far, frr = zip(*(by[t] for t in sorted(by)))
    assert list(far) == sorted(far, reverse=True) and list(frr) == sorted(frr)
    assert round(metrics.equal_error(sweep).first().threshold, 2) == 0.66
    assert all((r.far, r.frr) == (0, 0) for r in metrics.threshold_sweep(df.limit(0)).collect())
    assert one(spark, metrics.char_accuracy(F.lit(""), F.lit(None)), metrics.char_accuracy(F.lit("ab"), F.lit("")), metrics.char_accuracy(F.lit("abcd"), F.lit("abxd")))[0:3] == (1.0, 0.0, 0.75)


def test_audit_chain(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i, 5), "login", "é", "in", None, (i,) if i % 2 else None) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "seq long, event_time timestamp, event_type string, actor string, action string, subject string, detail struct<k:int>")
    df = df.withColumn("canonical", audit.canonical(df)).withColumn("chain", F.lit(0))
    first = df.orderBy("seq").first().canonical
    assert first == json.dumps({"t": "2024-01-01T00:00:01.000005", "type": "login", "actor": "é", "action": "in", "subject": None, "detail": {"k": 1}}, sort_keys=True, separators=(",", ":")).replace("\\u00e9", "\\u00E9")
    for key in (None, audit.chain_key(b"s")):
        log = audit.append(df.select("chain", "seq", "canonical"), key)
        log = spark.createDataFrame(log.collect(), log.schema)
        check = lambda x, key=key: tuple(audit.verify(x, key).where("chain = 0").first())[1:]
        assert check(log) == (True, 7, None)
        assert check(log.withColumn("canonical", F.when(F.col("seq") == 2, "{}").otherwise(F.col("canonical")))) == (False, 7, 2)
        assert check(log.where("seq <> 2")) == (False, 6, 3) and check(log.where("seq <> 1")) == (False, 6, 2)
        assert audit.verify(log.limit(0), key).collect() == [] and audit.verify(log, b"other").first().is_ok is False
        # other chains don't disturb, a chain may lie in several range partitions
        two = log.unionByName(audit.append(df.where("seq > 3").select(F.lit(1).alias("chain"), "seq", "canonical"), key))
        assert check(two.where("not (chain = 1 and seq = 6)")) == (True, 7, None)
        assert [tuple(r) for r in audit.verify(two.where("not (chain = 1 and seq = 6)"), key).where("chain = 1").collect()] == [(1, False, 3, 7)]


def test_zones(spark):
    as_of = dt.date(2024, 6, 1)
    cut = INVENTED.replace("<<<<<<<<<<<<<<<<<<<<\n", "\n", 1)
    texts = [SPECIMEN, INVENTED, INVENTED.replace("TS00123450", "TSOO12345O"), INVENTED.replace("9001158", "9OOllS8".upper()), INVENTED.replace("3506307", "3506308"), "PP" + INVENTED[1:44][:42] + INVENTED[44:], None, "", "just words", cut]
    got = zones.read_passports(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), F.lit(as_of)).orderBy("i").collect()
    codes = [[s.code for s in r.signals] for r in got]
    assert tuple(got[0].zone)[:6] == ("L898902C3", "ERIKSSON", "ANNA MARIA", "UTO", dt.date(1974, 8, 12), "F") and codes[0] == ["PASSPORT_EXPIRED"] and got[0].confidence == 0.92
    for k in (1, 2, 9):
        assert got[k].zone.valid and got[k].zone.surname == "SAMPLESON" and got[k].zone.given_names == "ALEX KIM" and codes[k] == [], k
    assert codes[4] == ["MRZ_CHECK_DIGIT_MISMATCH"] and got[4].confidence == 0.4
    assert codes[6] == codes[7] == codes[8] == ["MRZ_NOT_READ"] and got[6].zone is None


def test_adapters_hear_the_screen_pattern(spark):
    row = (0.5, 0.1, 0.2, 20.0, 0.4, 0.6, 0.3, 600_000, 102.0, 64.0)
    df = spark.createDataFrame([row, (*row[:7], 9_000_000, 255.0, 255.0)], "blockiness double, glare_ratio double, saturation double, contrast double, likeness_score double, quality_score double, ela_score double, pixels long, edge_mean double, edge_spread double")
    a, b = scoring.adapter_scores(df.withColumn("border_score", F.lit(9.0))).collect()
    rest = 0.5 * 0.34 + 0.1 * 1.1 * 0.18 + 0.2 * 0.9 * 0.1 + 6 / 26 * 0.06 + 0.15 / 0.55 * 0.04
    assert a.liveness_model == pytest.approx(rest + (0.4 * 0.55 + 0.5 * 0.45) * 0.28) and b.liveness_model == pytest.approx(rest + 0.28)
    assert (a.liveness_confidence, b.liveness_confidence, a.tamper_confidence, b.tamper_confidence) == pytest.approx((0.78, 0.9, 0.52 + 600 / 3400, 0.87))
    assert a.tamper_model == pytest.approx(0.3 * 0.55 + 0.5 * 0.24 + 0.2 * 0.11 + 0.15 / 0.55 * 0.1)


def test_targets_and_actions(spark):
    hand = [(0.5, 0.5)] * 20 + [(0.5, 0.92)]
    df = spark.createDataFrame([(hand, 50.0, 50.0, 4.1), (hand, 50.0, 50.0, 3.9)], "landmarks array<struct<x double, y double>>, l double, t double, s double")
    assert [r[0] for r in df.select(bursts.inside_target("landmarks", F.col("l"), F.col("t"), F.col("s"))).collect()] == [True, False]
    flags = spark.createDataFrame([(c, True, False, False, True) for c in ("blink", "open_mouth", "turn_left", "turn_right", "nod", None)], "c string, blink boolean, mouth_open boolean, turn_left boolean, turn_right boolean")
    assert [r[0] for r in flags.select(bursts.action_matches(F.col("c"))).collect()] == [True, False, False, True, False, False]


def test_even_frames(spark):
    df = spark.createDataFrame([(100, 3), (2, 5), (0, 3), (10, 0), (7, 1)], "c int, n int")
    assert [r[0] for r in df.select(scalars.even_frames(F.col("c"), F.col("n"))).collect()] == [[25, 50, 75], [0, 1], [], [], [3]]


def test_identification_over_many_blocks(spark, monkeypatch):
    """Blocks of gallery and probes give what one comparison gives; no gallery finds nobody."""
    for name, value in (("GALLERY_BYTES", 600), ("PROBE_BYTES", 400), ("BLOCK", 3), ("GALLERY_ROWS", 2)):
        monkeypatch.setattr(matching, name, value)
    rnd = random.Random(5)
    vector = lambda: [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(6)]
    faces = [(f"f{i:02d}", rnd.random() < 0.8, rnd.choice([vector(), vector(), vector(), [], None])) for i in range(60)]
    probes = [(i, rnd.choice([vector(), vector(), vector(), [], None])) for i in range(40)]
    gallery = spark.createDataFrame(faces, "face_id string, active boolean, embedding array<double>")
    asked = spark.createDataFrame(probes, "probe_id long, embedding array<double>")
    want = {}
    for i, v in probes:
        scores = [(round(min(1, max(0, (sum(a * b for a, b in zip(v, w)) + 1) / 2)), 4), f) for f, on, w in faces if on and w and v]
        top = max((s for s, _ in scores), default=0.0)
        want[i] = (min(f for s, f in scores if s == top) if top >= 0.72 else None, round(top, 2))
    assert {r.probe_id: (r.face_id, r.score) for r in matching.identify(asked, gallery).collect()} == want
    assert {(r.face_id, r.score) for r in matching.identify(asked, gallery.limit(0)).collect()} == {(None, 0.0)}
    assert matching.identify(asked.limit(0), gallery).collect() == []


def test_identification_by_another_scorer(spark):
    """A caller's measure: the share of equal signs."""
    rnd = random.Random(8)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    faces, probes = [(f"f{i:02d}", True, vector()) for i in range(30)], [(i, vector()) for i in range(20)]
    signs = lambda a, b: (np.sign(a)[:, None, :] == np.sign(b)[None, :, :]).mean(2)
    got = matching.identify(spark.createDataFrame(probes, "probe_id long, embedding array<double>"), spark.createDataFrame(faces, "face_id string, active boolean, embedding array<double>"), 0.8, signs)
    for r in got.collect():
        scores = {f: round(sum((a > 0) == (b > 0) for a, b in zip(probes[r.probe_id][1], v)) / 8, 4) for f, _, v in faces}
        top = max(scores.values())
        assert r.score == pytest.approx(round(top + 1e-9, 2)) and r.face_id == (min(f for f, s in scores.items() if s == top) if top >= 0.8 else None)
