"""Queries over throttles, codes, nonces and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.operators import throttle
from sealmark.plans.bindings import bind, oracle, table

DAY = 86400


def f1_sliding_limit(spark, sf):
    return throttle.sliding_window_limit(bind(spark, sf, "calls"), DAY, 2).select("key", "call_id", "admitted")


def f2_two_level_limit(spark, sf):
    return throttle.two_level_limit(bind(spark, sf, "calls"), 3600, 9, 2)


def f3_offered_load(spark, sf):
    return throttle.offered_load(bind(spark, sf, "calls"), DAY).select("call_id", "offered")


def f4_code_outcomes(spark, sf):
    return throttle.code_outcomes(bind(spark, sf, "contacts"), 3 * DAY, 2)


def _nonces(spark, sf):
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("session_id"), "ts", k.alias("k"))
    issued = rows.select("session_id").distinct().select(
        "session_id", F.explode(F.array(*(F.struct(F.lit(f"c{i}").alias("challenge_id"), F.lit("active" if i == 0 else "hand").alias("kind")) for i in range(4)))).alias("c")
    ).select("session_id", "c.*", F.concat("session_id", F.lit(":"), "c.challenge_id").alias("nonce"), (F.col("session_id").cast("long") % 5 != 0).alias("active_passed"))
    uses = rows.select(
        F.col("event_id").alias("use_id"), "session_id", F.concat(F.lit("c"), (F.col("k") % 5).cast("string")).alias("challenge_id"), "ts", (F.col("k") % 4 != 1).alias("passed"),
        F.when(F.col("k") % 11 == 0, F.lit(None)).when(F.col("k") % 7 == 0, "bad").otherwise(F.concat("session_id", F.lit(":c"), (F.col("k") % 5).cast("string"))).alias("nonce"),
    )
    return uses, issued


def f5_nonce_checks(spark, sf):
    return throttle.nonce_checks(*_nonces(spark, sf))


def f6_slow_steps(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("value") * 9).alias("elapsed_ms"))
    out = throttle.slow_steps(rows, "event_type", "elapsed_ms")
    return out.select("event_type", "n", "slow", F.round("mean_ms", 4).alias("mean_ms"), F.round("max_ms", 4).alias("max_ms"))


QUERIES = [f1_sliding_limit, f2_two_level_limit, f3_offered_load, f4_code_outcomes, f5_nonce_checks, f6_slow_steps]


def _fold(source: str, name: str, window_us: int, most: int) -> str:
    """Recursive CTEs for the limiter over `source` (key, call_id, us): the log of admitted times is a list."""
    return f"""{name}o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, call_id) AS n FROM {source}),
 {name} AS (SELECT key, call_id, n, true AS ok, [us] AS log FROM {name}o WHERE n = 1 UNION ALL
 SELECT o.key, o.call_id, o.n, len(list_filter(f.log, lambda t: t >= o.us - {window_us})) < {most}, CASE WHEN len(list_filter(f.log, lambda t: t >= o.us - {window_us})) < {most}
  THEN list_append(list_filter(f.log, lambda t: t >= o.us - {window_us}), o.us) ELSE list_filter(f.log, lambda t: t >= o.us - {window_us}) END FROM {name} f JOIN {name}o o ON o.key = f.key AND o.n = f.n + 1)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "f1_sliding_limit": _recursive(oracle("--with c AS (SELECT key, call_id, epoch_us(ts) AS us FROM calls), " + _fold("c", "f", DAY * 1_000_000, 2) + " SELECT key, call_id, ok AS admitted FROM f", "calls")),
    "f2_two_level_limit": _recursive(oracle("--with c AS (SELECT 1 AS key, call_id, epoch_us(ts) AS us FROM calls), " + _fold("c", "g", 3_600_000_000, 9)
        + ", d AS (SELECT client_ip AS key, calls.call_id, epoch_us(ts) AS us FROM calls JOIN g ON g.call_id = calls.call_id AND g.ok), " + _fold("d", "h", 3_600_000_000, 2)
        + " SELECT calls.call_id, CASE WHEN h.ok IS NULL THEN 'GLOBAL' WHEN NOT h.ok THEN 'CLIENT' ELSE 'OK' END AS outcome FROM calls LEFT JOIN h ON h.call_id = calls.call_id", "calls")),
    "f3_offered_load": oracle("SELECT call_id, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS offered FROM calls", "calls"),
    "f4_code_outcomes": _recursive(oracle("""--with o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM contacts),
 f AS (SELECT session_id, seq, n, kind, CASE WHEN kind = 'issue' THEN code END AS code, CASE WHEN kind = 'issue' THEN us + 259200000000 END AS until, 0 AS tries, false AS used, CASE WHEN kind = 'confirm' THEN 'NO_CONTACT_CHALLENGE' END AS outcome FROM o WHERE n = 1
 UNION ALL SELECT o.session_id, o.seq, o.n, o.kind,
  CASE WHEN o.kind = 'issue' THEN o.code WHEN f.until IS NULL OR o.us > f.until OR f.tries >= 2 THEN NULL ELSE f.code END,
  CASE WHEN o.kind = 'issue' THEN o.us + 259200000000 WHEN f.until IS NULL OR o.us > f.until OR f.tries >= 2 THEN NULL ELSE f.until END,
  CASE WHEN o.kind = 'issue' OR f.until IS NULL OR o.us > f.until OR f.tries >= 2 THEN 0 WHEN f.used THEN f.tries ELSE f.tries + 1 END,
  CASE WHEN o.kind = 'issue' OR f.until IS NULL OR o.us > f.until OR f.tries >= 2 THEN false ELSE f.used OR o.code = f.code END,
  CASE WHEN o.kind = 'issue' THEN NULL WHEN f.until IS NULL THEN 'NO_CONTACT_CHALLENGE' WHEN o.us > f.until THEN 'CODE_EXPIRED' WHEN f.tries >= 2 THEN 'TOO_MANY_ATTEMPTS' WHEN f.used THEN 'CODE_ALREADY_USED' WHEN o.code = f.code THEN 'OK' ELSE 'CODE_INVALID' END
 FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1) SELECT session_id, seq, outcome FROM f WHERE kind = 'confirm'""", "contacts")),
    "f5_nonce_checks": """WITH u AS (SELECT event_id AS use_id, user_id, ts, k % 5 AS ch, k % 4 <> 1 AS passed, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'bad' ELSE 'good' END AS nonce FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)),
 v AS (SELECT *, ch BETWEEN 1 AND 3 AND user_id % 5 <> 0 AND passed AND coalesce(nonce = 'good', false) AS valid FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ch, valid ORDER BY ts, use_id) AS nth FROM v)
 SELECT use_id, CASE WHEN ch = 0 THEN 409 WHEN ch = 4 THEN 400 WHEN user_id % 5 = 0 THEN 409 WHEN NOT passed THEN 400 WHEN valid AND nth = 1 THEN 200 ELSE 401 END AS status FROM r""",
    "f6_slow_steps": "SELECT event_type, count(*) AS n, count(*) FILTER (value * 9 >= 1000) AS slow, round(avg(value * 9), 4) AS mean_ms, round(max(value * 9), 4) AS max_ms FROM events GROUP BY event_type",
}
