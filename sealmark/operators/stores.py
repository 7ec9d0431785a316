"""Attempts and profiles: current rows, pages, summaries, retention, erasure, enrolment, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.functions.scalars import blind_index, mask_document_number
from sealmark.operators import audit
from sealmark.operators.components import connected_components
from sealmark.scratch import written

DECISIONS = ("passed", "pending", "rejected")


def attempt_upsert(steps: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per session: the last state, the first time, the last address that isn't empty, the number of steps.

    `stored` holds rows of an earlier call; they are merged by the same aggregation, so only sessions move.
    """
    order = F.struct("ts", "seq")
    new = steps.select(
        "session_id", F.struct(order.alias("at"), "user_id", "decision").alias("last"), F.col("ts").alias("created_at"),
        F.when(F.col("client_ip") != "", F.struct(order.alias("at"), "client_ip")).alias("address"), F.lit(1).cast("long").alias("step_count"),
    )
    if stored is not None:
        new = new.unionByName(stored.select("session_id", "last", "created_at", "address", "step_count"))
    return new.groupBy("session_id").agg(
        F.max_by("last", "last.at").alias("last"), F.min("created_at").alias("created_at"), F.max_by("address", "address.at").alias("address"), F.sum("step_count").alias("step_count")
    )


def attempt_rows(state: DataFrame) -> DataFrame:
    return state.select(
        "session_id", "last.user_id", "last.decision", F.col("address.client_ip").alias("client_ip"), "step_count", "created_at", F.col("last.at.ts").alias("updated_at")
    )


def attempt_page(attempts: DataFrame, decision: str | None = None, user_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; limit is held to 1..200 and offset to 0 or more."""
    if decision is not None:
        attempts = attempts.where(F.col("decision") == decision)
    if user_id is not None:
        attempts = attempts.where(F.col("user_id") == user_id)
    return attempts.orderBy(F.desc("updated_at"), "session_id").offset(max(0, offset)).limit(max(1, min(200, limit)))


def attempt_page_after(attempts: DataFrame, last: tuple | None = None, decision: str | None = None, user_id: str | None = None, limit: int = 50) -> DataFrame:
    """The page after `last`, the (updated_at, session_id) of the row where the page before it ended; without it the first.

    The order is that of attempt_page. However deep the page, only its rows are sorted out: the time of `last` is a
    plain comparison, which reaches the scan, so files and row groups of newer attempts aren't read.
    """
    if last is not None:
        at, session = F.lit(last[0]).cast(attempts.schema["updated_at"].dataType), F.lit(last[1])
        attempts = attempts.where((F.col("updated_at") <= at) & ((F.col("updated_at") < at) | (F.col("session_id") > session)))
    return attempt_page(attempts, decision, user_id, limit)


def decision_summary(attempts: DataFrame) -> DataFrame:
    """One row: a count per decision, 0 where there is none, and the total."""
    return attempts.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS), F.count("*").alias("total"))


def retained(rows: DataFrame, last_used: Column, as_of: Column, days: int) -> DataFrame:
    """rows used within `days` before as_of; days <= 0 keeps all."""
    return rows if days <= 0 else rows.where(~(last_used < as_of - F.expr(f"INTERVAL {days} DAYS")) | last_used.isNull())


def purge_count(rows: DataFrame, last_used: Column, as_of: Column, days: int) -> DataFrame:
    gone = F.lit(False) if days <= 0 else F.coalesce(last_used < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return rows.agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


def expired_sessions(sessions: DataFrame, as_of: Column, idle: str, absolute: str) -> DataFrame:
    """Sessions idle or alive for longer than allowed."""
    return sessions.where((as_of - F.expr(f"INTERVAL {idle}") > F.col("updated_at")) | (as_of - F.expr(f"INTERVAL {absolute}") > F.col("created_at")))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def erase(rows: DataFrame, requests: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the count erased); a request that isn't verified erases nothing."""
    wanted = requests.where("verified").select(key).distinct()
    return rows.join(wanted, key, "left_anti"), rows.join(wanted, key, "left_semi").agg(F.count("*").alias("erased"))


def shared_documents(profiles: DataFrame, key: str = "passport_number", member: str = "user_id") -> DataFrame:
    """Values of key that more than one member holds."""
    return profiles.groupBy(key).agg(F.count_distinct(member).alias("n_members"), F.min(member).alias("first_member")).where("n_members > 1")


def mark_logins(profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Set last_login_at of matched faces to their latest match."""
    latest = matches.groupBy("face_id").agg(F.max("at").alias("login_at"))
    return profiles.join(latest, "face_id", "left").withColumn("last_login_at", F.coalesce("login_at", "last_login_at")).drop("login_at")


def redacted(profiles: DataFrame, expose: bool = False) -> DataFrame:
    """Profiles for a reader who isn't trusted: no names and dates, document numbers masked."""
    if expose:
        return profiles
    hidden = [c for c in ("full_name", "last_name", "date_of_birth", "passport_expiry") if c in profiles.columns]
    out = profiles.withColumns({c: F.lit(None).cast(profiles.schema[c].dataType) for c in hidden})
    return out.withColumn("passport_number", mask_document_number(F.col("passport_number"))) if "passport_number" in out.columns else out


def capped(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """At most `most` rows of each group, in order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def interleaved(rows: DataFrame, group: str, order: list) -> DataFrame:
    """The place of each row when groups take turns in name order."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order))).orderBy("round", group)


def resumed(items: DataFrame, done: DataFrame, key: str, wanted: Column, target: int, order: list) -> DataFrame:
    """Items to do next: not done ones that want something, in order until `target` is produced, the last one cut to
    what is missing. Each produces one at least, so the first `target` of them are enough to look at."""
    left = items.join(done.select(key).distinct(), key, "left_anti").withColumn("wanted", wanted)
    left = left.where("wanted > 0").orderBy(*order).limit(max(0, target))
    before = F.coalesce(F.sum("wanted").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return left.withColumn("before", before).where(F.col("before") < target).withColumn("take", F.least(F.col("wanted"), F.lit(target) - F.col("before"))).drop("before")


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; per path the last new row wins, else the last old one. Both have `path` and `pos`."""
    both = old.withColumn("source_rank", F.lit(0)).unionByName(new.withColumn("source_rank", F.lit(1)))
    last = Window.partitionBy("path").orderBy(F.desc("source_rank"), F.desc("pos"))
    return both.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "source_rank", "pos").orderBy("path")


def admin_overview(attempts: DataFrame, profiles: DataFrame, log: DataFrame, profile_days: int, attempt_days: int, key: bytes | None = None, log_enabled: bool = True) -> DataFrame:
    """One row: attempts per decision, enrolled faces, whether every chain of the audit log holds and how many entries
    they have, and the settings. log: chain, seq, canonical, prev_hash, entry_hash."""
    faces = profiles.agg(F.count_if("active").alias("enrolled_face_ids"))
    chains = audit.verify(log, key).agg(F.coalesce(F.bool_and("is_ok"), F.lit(True)).alias("audit_chain_ok"), F.coalesce(F.sum("entries"), F.lit(0)).alias("audit_entries"))
    row = decision_summary(attempts).crossJoin(faces).crossJoin(chains)  # one row each
    return row.withColumns({"audit_log_enabled": F.lit(log_enabled), "profile_retention_days": F.lit(profile_days), "attempt_retention_days": F.lit(attempt_days)})


def subject_export(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """What the owner of a face gets: request_id, verified, reason_codes, match_score, profile (a struct, as stored).

    requests: request_id, reasons (of the login burst, in order), face_id (of the match, null below its threshold),
    score. A request with reasons isn't matched: no score and no profile. One without that meets no active profile
    gets NO_MATCH. Nothing of a profile is masked: it is its owner's.
    """
    own = profiles.where("active").select(F.col("face_id").alias("own_face"), F.struct(*profiles.columns).alias("profile"))
    free = F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0
    rows = requests.withColumn("asked_face", F.when(free, F.col("face_id")))
    rows = rows.join(own, F.col("asked_face") == F.col("own_face"), "left")
    reasons = F.when(~free, F.col("reasons")).when(F.col("own_face").isNull(), F.array(F.lit("NO_MATCH"))).otherwise(F.array().cast("array<string>"))
    score = F.when(free, F.round(F.coalesce("score", F.lit(0.0)), 2)).otherwise(0.0)
    return rows.select("request_id", F.col("own_face").isNotNull().alias("verified"), reasons.alias("reason_codes"), score.alias("match_score"), "profile")


KEPT_OF_PROFILE = ("face_id", "user_id", "passport", "session_id", "active", "enrolled_at", "consent_version", "consented_at")


def enrol(stored: DataFrame, batch: DataFrame, index_key: bytes | None = None, consent_version: str | None = None) -> DataFrame:
    """The profile table after a batch of enrolments, in order of seq, with the outcome of each.

    Both have user_id, passport_number, session_id; stored also face_id, active and, if it has them, enrolled_at,
    consent_version, consented_at; batch also seq, decision, has_template and, if it has them, enrolled_at,
    document_number and id_number, which stand in for a missing passport_number. Enrolments that don't pass or lack
    a template are ignored. With index_key numbers are looked up by their keyed index: stored has it as
    passport_index, in place of the number, and so has the result.

    A number active under another user is a conflict. Else the active row of the same user, or of the same number, or
    any row of the same session is updated and keeps its face_id; without one a new face is enrolled. Other rows of
    the user and of the number go, active or not. When another row still has the session, that is a conflict too. A
    conflict writes nothing. An enrolment is stamped with its time and consent_version.

    Rows (stored or new) that share a user, a number or a session with each other form components; a component's
    rows stream through one task in order, which holds its live rows alone. Returns face_id, user_id,
    passport_number (passport_index), session_id, active, outcome (stored, enrolled, updated, conflict), enrolled_at,
    consent_version, consented_at.
    """
    number = "passport_number" if index_key is None else "passport_index"
    keys = ["user_id", "passport", "session_id"]
    at = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    given = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("passport_number", "document_number", "id_number") if c in batch.columns))
    new = batch.where("decision = 'passed' and has_template").select(
        "seq", F.concat(F.lit("n"), F.col("seq").cast("string")).alias("face_id"), F.trim("user_id").alias("user_id"), (given if index_key is None else blind_index(given, index_key)).alias("passport"),
        "session_id", F.lit(True).alias("active"), at(batch, "enrolled_at", "timestamp"), F.lit(consent_version).cast("string").alias("consent_version"), at(batch, "enrolled_at", "timestamp").alias("consented_at"),
    )
    old = stored.select(
        F.lit(-1).cast("long").alias("seq"), "face_id", "user_id", F.col(number).alias("passport"), "session_id", "active",
        at(stored, "enrolled_at", "timestamp"), at(stored, "consent_version", "string"), at(stored, "consented_at", "timestamp"),
    )
    rows = written(old.unionByName(new).withColumn("node", F.xxhash64("seq", "face_id")), "enrol")
    held = rows.select("node", F.explode(F.array(*(F.concat(F.lit(f"{c}:"), F.col(c)) for c in keys))).alias("key")).where("key is not null")
    hubs = held.groupBy("key").agg(F.min("node").alias("hub"))
    links = held.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rows = rows.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, _Profiles()
        for batch in batches:
            done: list[tuple] = []
            for component, seq, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if component != now:
                    done += table.rows()
                    now, table = component, _Profiles()
                conflict = table.take(seq < 0, *row)
                if conflict:
                    done.append(conflict)
            yield _profile_batch(done)
        yield _profile_batch(table.rows())

    ordered = rows.select("component", "seq", *KEPT_OF_PROFILE).repartition("component").sortWithinPartitions("component", "seq", "face_id")
    out = ordered.mapInArrow(fold, "face_id string, user_id string, passport string, session_id string, active boolean, enrolled_at timestamp, consent_version string, consented_at timestamp, outcome string")
    return out.select("face_id", "user_id", F.col("passport").alias(number), "session_id", "active", "outcome", "enrolled_at", "consent_version", "consented_at")


def _profile_batch(rows: list[tuple]) -> pa.RecordBatch:
    time = pa.timestamp("us", "UTC")
    kinds = [*[pa.string()] * 4, pa.bool_(), time, pa.string(), time, pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEPT_OF_PROFILE, "outcome"])


class _Profiles:
    """The live rows of a component, found by user, passport or session. A row: KEPT_OF_PROFILE and its outcome."""

    def __init__(self):
        self.live: dict[int, tuple] = {}
        self.by = ({}, {}, {})
        self.n = 0

    def rows(self) -> list[tuple]:
        return list(self.live.values())

    def _holders(self, k: int, value) -> list[int]:
        return [] if value is None else list(self.by[k].get(value, ()))

    def _drop(self, nr: int) -> None:
        row = self.live.pop(nr)
        for k in range(3):
            if row[k + 1] is not None:
                self.by[k][row[k + 1]].pop(nr)

    def take(self, stored: bool, face, *rest) -> tuple | None:
        """Add a stored row or enrol a new one; a conflict is given back."""
        values, outcome = rest[:3], "stored"
        if not stored:
            user, passport, session = (self._holders(k, v) for k, v in enumerate(values))
            active = lambda found: [i for i in found if self.live[i][4]]
            mine, document = active(user), active(passport)
            if any(self.live[i][1] != values[0] for i in document):
                return face, *rest, "conflict"
            same = next((min(found) for found in (mine, document, session) if found), None)
            gone = {*user, *passport, *([] if same is None else [same])}
            if any(i not in gone for i in session):
                return face, *rest, "conflict"
            outcome = "enrolled"
            if same is not None:
                face, outcome = self.live[same][0], "updated"
            for i in gone:
                self._drop(i)
        self.live[self.n] = (face, *rest, outcome)
        for k, v in enumerate(values):
            if v is not None:
                self.by[k].setdefault(v, {})[self.n] = True
        self.n += 1
        return None
