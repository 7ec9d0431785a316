import datetime as dt
import random

from pyspark.sql import functions as F

from sealmark.functions import scalars
from sealmark.operators import audit, datasets, stores
from sealmark.operators.components import connected_components

STEPS = "session_id string, seq long, ts timestamp, user_id string, decision string, client_ip string"


def at(day, second=0):
    return dt.datetime(2024, 1, day, 0, 0, second)


def test_attempts_keep_last_state_first_time_and_last_address(spark):
    rows = [("s", 1, at(1), "u", "pending", "a"), ("s", 2, at(2), "u", "passed", ""), ("s", 3, at(2), "u", "rejected", None), ("t", 4, at(3), "v", "pending", None)]
    df = spark.createDataFrame(rows, STEPS)
    whole = {tuple(r) for r in stores.attempt_rows(stores.attempt_upsert(df)).collect()}
    assert whole == {("s", "u", "rejected", "a", 3, at(1), at(2)), ("t", "v", "pending", None, 1, at(3), at(3))}
    stored = stores.attempt_upsert(df.where("seq < 2"))
    assert {tuple(r) for r in stores.attempt_rows(stores.attempt_upsert(df.where("seq >= 2"), stored)).collect()} == whole
    counts = stores.decision_summary(stores.attempt_rows(stores.attempt_upsert(df))).first()
    assert (counts.passed, counts.pending, counts.rejected, counts.total) == (0, 1, 1, 2)
    assert stores.decision_summary(stores.attempt_rows(stores.attempt_upsert(df.limit(0)))).first().total == 0


def test_pages_are_clamped(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("session_id"), F.lit("u").alias("user_id"), F.lit("passed").alias("decision"), F.col("id").alias("updated_at"))
    assert stores.attempt_page(df, limit=1000).count() == 200 and stores.attempt_page(df, limit=0, offset=-5).first().updated_at == 299
    assert stores.attempt_page(df, decision="rejected").count() == 0


def test_retention_is_strict_and_idempotent(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2023, 12, 31)), (3, None)], "id long, used date")
    keep = lambda d, n: stores.retained(d, F.col("used"), F.lit(dt.date(2024, 1, 31)), n)
    assert {r.id for r in keep(df, 30).collect()} == {1, 3} == {r.id for r in keep(keep(df, 30), 30).collect()}
    assert keep(df, 0).count() == 3
    gone = stores.purge_count(df, F.col("used"), F.lit(dt.date(2024, 1, 31)), 30).first()
    assert (gone.purged, gone.kept) == (1, 2)


def test_erasure_needs_verification(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "user_id string")
    asks = spark.createDataFrame([("b", True), ("a", False)], "user_id string, verified boolean")
    kept, erased = stores.erase(df, asks)
    assert [r.user_id for r in kept.collect()] == ["a"] and erased.first().erased == 2


def test_manifest_new_rows_win(spark):
    old = spark.createDataFrame([("p", 1, "old"), ("q", 2, "old")], "path string, pos long, expected string")
    new = spark.createDataFrame([("q", 1, "new"), ("q", 2, "newer"), ("a", 3, "new")], "path string, pos long, expected string")
    assert [tuple(r) for r in stores.manifest_upsert(old, new).collect()] == [("a", "new"), ("p", "old"), ("q", "newer")]


STORED = "face_id string, user_id string, passport_number string, session_id string, active boolean, enrolled_at timestamp, consent_version string, consented_at timestamp"
BATCH = "seq long, user_id string, passport_number string, document_number string, id_number string, session_id string, decision string, has_template boolean, enrolled_at timestamp"


def enrolled(spark, stored, batch, key=None):
    """stored: face, user, passport, session, active; batch: seq, user, passport, session, decision, has_template."""
    old = spark.createDataFrame([(*r, at(1), "v1", at(1)) for r in stored], STORED)
    if key:
        old = old.withColumn("passport_index", scalars.blind_index(F.col("passport_number"), key)).withColumn("passport_number", F.lit(None).cast("string"))
    # the number comes as a passport's, another document's or a card's
    new = [(q, u, p if q % 3 == 0 else None, p if q % 3 == 1 else "", p if q % 3 == 2 else None, s, d, h, at(2)) for q, u, p, s, d, h in batch]
    return stores.enrol(old, spark.createDataFrame(new, BATCH), key, "v2")


def test_enrolment(spark):
    stored = [("f1", "u1", "P1", "s1", True), ("f2", "u2", "P2", "s2", False), ("f3", "u3", "P3", "s3", False), ("f9", "u9", "P9", "s9", True)]
    batch = [
        (1, "u1", "P5", "n1", "passed", True),   # the same user takes a new passport, which frees P1
        (2, "u4", "P1", "n2", "passed", True),   # so this one may have it
        (3, "u5", "P5", "n3", "passed", True),   # taken by u1: a conflict
        (4, "u6", "P2", "n4", "passed", True),   # P2's holder isn't active: a new face, and the holder's row goes
        (5, "u7", None, "n5", "pending", True), (6, "u8", "P7", "n6", "passed", False),
        (7, " u3 ", "P8", "n7", "passed", True),  # the user's own row isn't active: a new face, and that row goes
        (8, "u10", "P10", "s9", "passed", True),  # the session's row is updated, though it is another user's
        (9, "u10", None, "n2", "passed", True),   # a session that another row keeps: a conflict
    ]
    got = {(r.face_id, r.user_id, r.passport_number, r.session_id, r.outcome) for r in enrolled(spark, stored, batch).collect()}
    assert got == {
        ("f1", "u1", "P5", "n1", "updated"), ("n2", "u4", "P1", "n2", "enrolled"), ("n3", "u5", "P5", "n3", "conflict"), ("n4", "u6", "P2", "n4", "enrolled"), ("n7", "u3", "P8", "n7", "enrolled"),
        ("f9", "u10", "P10", "s9", "updated"), ("n9", "u10", None, "n2", "conflict"),
    }


def test_enrolment_stamps_consent_and_hides_numbers(spark):
    stored, batch = [("f1", "u1", "P1", "s1", True), ("f2", "u2", "P2", "s2", True)], [(1, "u1", " p2", "n1", "passed", True), (2, "u1", "p7 ", "n2", "passed", True)]
    rows = {r.face_id: r for r in enrolled(spark, stored, batch, b"key").collect()}
    assert "passport_number" not in rows["f1"].asDict() and {f: r.outcome for f, r in rows.items()} == {"f1": "updated", "f2": "stored", "n1": "conflict"}
    index = spark.range(1).select(scalars.blind_index(F.lit("P7"), b"key")).first()[0]
    assert rows["f1"].passport_index == index and (rows["f1"].consent_version, rows["f1"].consented_at, rows["f1"].enrolled_at) == ("v2", at(2), at(2))
    assert (rows["f2"].consent_version, rows["f2"].consented_at) == ("v1", at(1))


def plain_enrolment(stored, batch):
    """Each enrolment in turn against the whole table: who holds the number, whose row it becomes, what else goes."""
    table, conflicts = {r[0]: dict(zip(("user", "number", "session", "active"), r[1:]), outcome="stored") for r in sorted(stored)}, []
    for seq, user, number, session, decision, has in sorted(batch):
        if decision != "passed" or not has:
            continue
        of = lambda key, value, live: [f for f, t in table.items() if value is not None and t[key] == value and (t["active"] or not live)]
        new = {"user": user, "number": number, "session": session, "active": True}
        by_user, by_number = of("user", user, True), of("number", number, True)
        if any(table[f]["user"] != user for f in by_number):
            conflicts.append((f"n{seq}", *new.values(), "conflict"))
            continue
        own = (by_user or by_number or of("session", session, False) or [None])[0]
        left = {f: t for f, t in table.items() if f != own and t["user"] != user and (number is None or t["number"] != number)}
        if any(t["session"] == session for t in left.values()):  # sessions are unique in the table
            conflicts.append((f"n{seq}", *new.values(), "conflict"))
            continue
        table = left | {own or f"n{seq}": new | {"outcome": "updated" if own else "enrolled"}}
    return sorted([(f, *t.values()) for f, t in table.items()] + conflicts, key=str)


def test_enrolment_against_plain_fold(spark):
    rnd = random.Random(3)
    name = lambda k, n: f"{k}{rnd.randrange(n)}"
    stored = [(f"f{i:02d}", f"u{i}", f"p{i}", f"s{i}", rnd.random() < 0.6) for i in range(40)]
    batch = [(i, name("u", 60), name("p", 60) if rnd.random() < 0.9 else None, name("s", 60), rnd.choice(["passed", "passed", "pending"]), rnd.random() < 0.9) for i in range(200)]
    got = [tuple(r[c] for c in ("face_id", "user_id", "passport_number", "session_id", "active", "outcome")) for r in enrolled(spark, stored, batch).collect()]
    want = plain_enrolment(stored, batch)
    assert sorted(got, key=str) == want and len({r[5] for r in want}) == 4


def test_pages_by_key_equal_the_whole_order(spark, tmp_path):
    rows = [(f"s{i:03d}", f"u{i % 3}", ("passed", "rejected")[i % 2], at(1 + i % 5)) for i in range(97)]
    spark.createDataFrame(rows, "session_id string, user_id string, decision string, updated_at timestamp").write.parquet(str(tmp_path / "attempts"))
    df = spark.read.parquet(str(tmp_path / "attempts"))
    for kind in (None, "rejected"):
        want = sorted((r for r in rows if kind in (None, r[2])), key=lambda r: (-r[3].timestamp(), r[0]))
        got, last = [], None
        while True:
            page = stores.attempt_page_after(df, last, decision=kind, limit=7)
            part = [tuple(r) for r in page.collect()]
            got += part
            if len(part) < 7:
                break
            last = part[-1][3], part[-1][0]
        assert got == want
    assert "PushedFilters: [IsNotNull(updated_at), LessThanOrEqual(updated_at" in stores.attempt_page_after(df, (at(3), "s050"))._jdf.queryExecution().toString()


def test_subject_export(spark):
    profiles = spark.createDataFrame([("f1", "u1", "P123456", True), ("f2", "u2", "P2", False)], "face_id string, user_id string, passport_number string, active boolean")
    asks = spark.createDataFrame([(1, None, "f1", 0.876), (2, ["MULTIPLE_FACES"], "f1", 0.9), (3, [], "f2", 0.8), (4, [], None, 0.5), (5, [], "f9", None)], "request_id int, reasons array<string>, face_id string, score double")
    got = {r.request_id: (r.verified, r.reason_codes, r.match_score, r.profile and r.profile.asDict()) for r in stores.subject_export(asks, profiles).collect()}
    assert got == {
        1: (True, [], 0.88, {"face_id": "f1", "user_id": "u1", "passport_number": "P123456", "active": True}), 2: (False, ["MULTIPLE_FACES"], 0.0, None),
        3: (False, ["NO_MATCH"], 0.8, None), 4: (False, ["NO_MATCH"], 0.5, None), 5: (False, ["NO_MATCH"], 0.0, None),
    }


def test_overview(spark):
    attempts = spark.createDataFrame([("passed",), ("passed",), ("rejected",)], "decision string")
    profiles = spark.createDataFrame([(True,), (False,)], "active boolean")
    log = audit.append(spark.createDataFrame([(c, i, f"e{i}") for c in "ab" for i in range(5)], "chain string, seq long, canonical string"))
    row = lambda x: stores.admin_overview(attempts, profiles, x, 365, 90).first()
    assert tuple(row(log)) == (2, 0, 1, 3, 1, True, 10, True, 365, 90)
    assert tuple(row(log.where("chain <> 'b' or seq <> 2")))[5:7] == (False, 9) and tuple(row(log.limit(0)))[5:7] == (True, 0)


def test_labels_by_paths(spark):
    paths = ["live_user_provided/a.jpg", "spoof_unknown/x/axon_large_1.PNG", "spoof_mask_cutout/axon_print_paper9.bmp", "spoof_print_paper/axon_display_replay.webp", "other/a.jpg", "live_user_provided/a.txt", "live_user_provided", "spoof_unknown/.jpg", None]
    got = {r.relative: (r.expected, r.attack_type, r.source) for r in datasets.selfie_labels(spark.createDataFrame([(p,) for p in paths], "relative string")).collect()}
    assert got == {
        paths[0]: ("live", "live_selfie", "user_provided"), paths[1]: ("spoof", "unknown_spoof", "AxonData/face-anti-spoofing-dataset"),
        paths[2]: ("spoof", "print_paper_or_cardboard_mask", "AxonData/print-cardboard-mask-face-spoofing"), paths[3]: ("spoof", "screen_replay", "AxonData/Display_replay_attacks"),
    }
    paths = ["a/AZE-Passport/1.jpg", "grc_passport_2.TIFF", "lva_passport/mask_1.png", "Mask/srb_passport/1.png", "esp_id/1.jpg", "aze_passport/1.json"]
    got = {r.path: r.document_type for r in datasets.document_images(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: "aze_passport", paths[1]: "grc_passport", paths[3]: "srb_passport"}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 8), (8, 3)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 8, 9)}, 4: 4, 5: 4, **{i: 100 for i in range(100, 161)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_resume_cuts_the_last_item(spark):
    items, done = spark.range(6), spark.createDataFrame([(0,)], "id long")
    assert [(r.id, r.take) for r in stores.resumed(items, done, "id", F.lit(3), 7, ["id"]).collect()] == [(1, 3), (2, 3), (3, 1)]
