"""Queries over audit logs and encrypted columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions import crypto
from sealmark.functions.scalars import blind_index
from sealmark.operators import audit, stores
from sealmark.plans.bindings import bind, oracle, table
from sealmark.plans.store_queries import AS_OF, ATTEMPTS, _attempts


def _log(spark, sf):
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("event_time"), "event_type", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"), F.lit("login").alias("action"),
        F.when(k % 4 != 0, F.concat(F.lit("é"), k.cast("string"))).alias("subject"), F.when(k % 3 != 0, F.struct(k.alias("k"))).alias("detail"), (F.col("event_id") % 16).alias("chain"),
    )
    return rows.withColumn("canonical", audit.canonical(rows))


def h1_canonical(spark, sf):
    return _log(spark, sf).select("seq", "canonical")


def h2_append(spark, sf):
    return audit.append(_log(spark, sf).select("chain", "seq", "canonical")).select("chain", "seq", "prev_hash", "entry_hash")


def h3_verify(spark, sf):
    """Sixteen chains, two rows of them forged and one taken out."""
    log = audit.append(_log(spark, sf).select("chain", "seq", "canonical"))
    log = log.where("seq <> 9001").withColumn("canonical", F.when(F.col("seq").isin(5003, 777), F.concat("canonical", F.lit(" "))).otherwise(F.col("canonical")))
    return audit.verify(log)


def h4_newest(spark, sf):
    return audit.newest(_log(spark, sf).select("seq", "event_type", "actor"), 500)


KEY = audit.chain_key(b"secret")


def h5_keyed_hash(spark, sf):
    return _log(spark, sf).select("seq", audit.entry_hash(F.lit(audit.GENESIS), F.col("canonical"), KEY).alias("entry_hash"))


def h6_event_counts(spark, sf):
    return audit.event_counts(_log(spark, sf))


def h6_failures(spark, sf):
    return audit.failures_by_actor(_log(spark, sf), "error")


def h7_governance_event(spark, sf):
    counts = stores.purge_count(_attempts(spark, sf), F.col("updated_at"), F.lit(AS_OF).cast("timestamp_ntz"), 20)
    row = audit.governance_event(counts, "purge_attempts", F.lit(AS_OF).cast("timestamp_ntz"))
    return row.select(audit.canonical(row).alias("canonical"))


def b7_blind_index(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", blind_index(F.concat(F.lit(" "), "c_name"), b"primary").alias("bidx"))


def b8_encrypt_round_trip(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", crypto.encrypt(F.to_json(F.struct("c_name", "c_mktsegment")), b"k1").alias("pii"))
    other = crypto.decrypt(F.col("pii"), b"other")
    return rows.select("c_custkey", F.from_json(crypto.decrypt(F.col("pii"), b"k2", b"k1"), "c_name string, c_mktsegment string")["c_name"].alias("c_name"), other.isNull().alias("is_hidden"))


def b9_key_rotation(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, crypto.encrypt(F.col("c_name"), b"old")).otherwise(crypto.encrypt(F.col("c_name"), b"new")).alias("pii"))
    out = crypto.rotate(rows, "pii", b"new", b"old")
    return out.select("c_custkey", crypto.decrypt(F.col("pii"), b"new").alias("c_name"), F.col("pii").startswith(crypto.PREFIX).alias("is_encrypted"))


QUERIES = [h1_canonical, h2_append, h3_verify, h4_newest, h5_keyed_hash, h6_event_counts, h6_failures, h7_governance_event, b7_blind_index, b8_encrypt_round_trip, b9_key_rotation]

LOG = """WITH RECURSIVE e AS (SELECT event_id AS seq, ts AS event_time, event_type, 'user-' || user_id AS actor, 'login' AS action, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
 l AS (SELECT *, '{"action":"login","actor":"' || actor || '","detail":' || CASE WHEN k % 3 <> 0 THEN '{"k":' || k || '}' ELSE '{}' END || ',"subject":' || CASE WHEN k % 4 <> 0 THEN '"\\u00E9' || k || '"' ELSE 'null' END || ',"t":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || '","type":"' || event_type || '"}' AS canonical FROM e)
"""
_HMAC = "sha256({o} || unhex(sha256({i} || encode({m}))))"


def _pads(key: bytes) -> dict:
    pad = lambda x: "from_hex('" + bytes(b ^ x for b in key.ljust(64, b"\0")).hex() + "')"
    return {"i": pad(0x36), "o": pad(0x5C)}


def _bidx_key() -> bytes:
    import hashlib

    return hashlib.sha256(b"primary|blind-index").digest()


SQL = {
    "h1_canonical": LOG + "SELECT seq, canonical FROM l",
    "h2_append": LOG + """, o AS (SELECT seq, seq % 16 AS chain, canonical, row_number() OVER (PARTITION BY seq % 16 ORDER BY seq) AS n FROM l),
 f AS (SELECT chain, seq, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || canonical) AS entry_hash FROM o WHERE n = 1 UNION ALL
 SELECT o.chain, o.seq, o.n, f.entry_hash, sha256(f.entry_hash || '|' || o.canonical) FROM f JOIN o ON o.chain = f.chain AND o.n = f.n + 1) SELECT chain, seq, prev_hash, entry_hash FROM f""",
    "h3_verify": """SELECT event_id % 16 AS chain, count(*) FILTER (event_id <> 9001) AS entries, min(event_id) FILTER (event_id IN (777, 5003) OR (event_id = 9017)) AS broken_at,
 min(event_id) FILTER (event_id IN (777, 5003) OR (event_id = 9017)) IS NULL AS is_ok FROM events GROUP BY event_id % 16""",
    "h4_newest": LOG + "SELECT seq, event_type, actor FROM l ORDER BY seq DESC LIMIT 500",
    "h5_keyed_hash": LOG + "SELECT seq, " + _HMAC.format(m="repeat('0', 64) || '|' || canonical", **_pads(KEY)) + " AS entry_hash FROM l",
    "h6_event_counts": LOG + "SELECT event_type, action, count(*) AS n, count(DISTINCT actor) AS actors FROM l GROUP BY event_type, action",
    "h6_failures": LOG + "SELECT actor, count(*) AS failures, max(event_time) AS last_at FROM l WHERE event_type = 'error' GROUP BY actor",
    "h7_governance_event": oracle(ATTEMPTS + f""", c AS (SELECT count(*) FILTER (updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS purged, count(*) FILTER (updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS kept FROM attempts)
 SELECT '{{"action":"purge_attempts","actor":"system","detail":{{"kept":' || kept || ',"purged":' || purged || '}},"subject":null,"t":"2024-01-30T00:00:00.000000","type":"governance"}}' AS canonical FROM c""", "steps"),
    "b7_blind_index": "SELECT c_custkey, " + _HMAC.format(m="upper(trim(' ' || c_name))", **_pads(_bidx_key())) + " AS bidx FROM customer",
    "b8_encrypt_round_trip": "SELECT c_custkey, c_name, true AS is_hidden FROM customer",
    "b9_key_rotation": "SELECT c_custkey, c_name, c_custkey % 3 <> 0 AS is_encrypted FROM customer",
}
