"""Queries over masking, names, addresses, dates and sampling columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealmark.functions import scalars
from sealmark.operators import datasets, stores
from sealmark.plans.bindings import bind, oracle, table


def _numbers():
    k = F.col("c_custkey")
    return F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), F.substring(F.concat(F.lit("P"), (k * 7919).cast("string")), F.lit(1), (k % 9).cast("int"))))


def b1_mask_number(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.mask_document_number(_numbers()).alias("masked"))


def b2_mask_contact(spark, sf):
    k = F.col("c_custkey")
    contact = F.when(k % 3 == 0, F.concat("c_name", F.lit("@example.com"))).when(k % 3 == 1, F.concat(F.lit("+8562055"), k.cast("string"))).otherwise((k % 100).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", scalars.mask_contact(contact).alias("masked"))


def b3_redact_profile(spark, sf):
    return stores.redacted(bind(spark, sf, "profiles").select("face_id", "full_name", "passport_number", "nationality"))


def b4_split_name(spark, sf):
    name = F.concat_ws(" ", F.regexp_replace("p_name", " ", "<"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")))
    n = scalars.split_name(F.when(F.col("p_partkey") % 50 == 0, F.lit("  ")).otherwise(name))
    return table(spark, sf, "part").select("p_partkey", n["first_name"].alias("first_name"), n["last_name"].alias("last_name"))


def b5_age(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.age_at(F.col("o_orderdate"), F.lit("2024-02-29").cast("date")).alias("age"))


def b6_client_address(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    edge = F.when(k % 5 == 0, F.concat(F.lit(" 1.1.1."), (k % 256).cast("string"), F.lit(" , 9.9.9.9")))
    forwarded = F.when(k % 3 == 0, F.concat(F.lit("2.2.2."), (k % 256).cast("string"), F.lit(",8.8.8.8"))).when(k % 3 == 1, F.lit(" "))
    host = F.when(k % 7 != 0, F.lit("3.3.3.3"))
    return e.select("event_id", scalars.client_address(edge, forwarded, host, True).alias("trusted"), scalars.client_address(edge, forwarded, host, False).alias("direct"))


def b11_consent_versions(spark, sf):
    return bind(spark, sf, "profiles").groupBy("consent_version").agg(F.count("*").alias("n"))


def b12_number_checks(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    raw = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "x").when(F.col("event_id") % 5 == 2, F.lit(None)).otherwise(k)
    return table(spark, sf, "events").select("event_id", scalars.number_check(raw).alias("plain"), scalars.number_check(raw, 1.0).alias("strict"))


FOLDERS = ("replay_phone", "Paper%20print", "latex_mask", "live", "silicone", "cutout")


def b13_attack_class(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("page_id") % len(FOLDERS) + 1).cast("int"))
    url = F.when(F.col("page_id") % 11 == 0, F.col("url")).otherwise(F.concat(F.lit("https://host/ds/resolve/main/"), folder, F.lit("/v"), F.col("page_id").cast("string"), F.lit(".mp4?x=1")))
    return table(spark, sf, "pages").select("page_id", scalars.attack_class(url).alias("attack"))


def b14_document_type(spark, sf):
    """A path for every page: known and unknown types, in either case, annotations and other files among them."""
    k = F.col("page_id")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    path = F.concat(F.lit("set/"), pick(("aze_passport", "GRC-Passport", "lva-passport", "SRB_passport", "esp_id", "mask_grc_passport"), k), F.lit("/"), pick(("scan", "photo", "x_Mask", "GroundTruth", "segments", "page"), F.floor(k / 6)), k.cast("string"), pick((".jpg", ".TIFF", ".json", ".png"), F.floor(k / 36)))
    return datasets.document_images(table(spark, sf, "pages").select("page_id", path.alias("path"))).select("page_id", "document_type")


def b15_sample_frames(spark, sf):
    n, count = (F.col("doc_id") % 7).cast("int"), F.col("n_chars") - 200
    text = lambda a: F.concat_ws(",", a.cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", text(scalars.sample_frames(count, n)).alias("frames"), text(scalars.even_frames(count % 40, n)).alias("even"))


def b18_name_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", scalars.name_tokens(scalars.romanized(F.col("text")))).alias("tokens"))


def b19_loose_date(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "dd MMM yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("31 FEB "), F.year(d).cast("string"))).otherwise("none")
    return table(spark, sf, "orders").select("o_orderkey", scalars.loose_date(text).alias("parsed"))


def b20_lighting(spark, sf):
    e = table(spark, sf, "events")
    lum = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.col("event_id") * (i + 7), F.col("event_id") % 90 + 10) / 100.0 + F.when(F.col("event_id") % 4 == 0, 0.6).otherwise(0.0))
    return e.select("event_id", scalars.lighting_status(lum).alias("status"))


QUERIES = [b1_mask_number, b2_mask_contact, b3_redact_profile, b4_split_name, b5_age, b6_client_address, b11_consent_versions, b12_number_checks, b13_attack_class, b14_document_type, b15_sample_frames, b18_name_tokens, b19_loose_date, b20_lighting]

_MASK = "CASE WHEN {0} IS NULL OR {0} = '' THEN {0} WHEN length(trim({0})) <= 4 THEN repeat('•', length(trim({0}))) ELSE substr(trim({0}), 1, 2) || repeat('•', length(trim({0})) - 4) || right(trim({0}), 2) END"
_TITLE = "array_to_string([upper(x[1:1]) || lower(x[2:]) for x in regexp_extract_all({0}, '\\p{{L}}+|\\P{{L}}+')], '')"
SQL = {
    "b1_mask_number": "WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '' ELSE ' ' || substr('P' || (c_custkey * 7919), 1, (c_custkey % 9)::INT) END AS n FROM customer) SELECT c_custkey, " + _MASK.format("n") + " AS masked FROM n",
    "b2_mask_contact": "WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '@example.com' WHEN 1 THEN '+8562055' || c_custkey ELSE (c_custkey % 100)::VARCHAR END AS c FROM customer) SELECT c_custkey, CASE WHEN contains(c, '@') THEN substr(c, 1, 1) || '***@' || split_part(c, '@', 2) WHEN length(c) > 4 THEN '***' || right(c, 4) ELSE '***' END AS masked FROM n",
    "b3_redact_profile": oracle("SELECT face_id, NULL::VARCHAR AS full_name, " + _MASK.format("passport_number") + " AS passport_number, nationality FROM profiles", "profiles"),
    "b4_split_name": "WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE replace(p_name, ' ', '<') || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END END AS n FROM part), p AS (SELECT p_partkey, list_filter(regexp_split_to_array(replace(n, '<', ' '), '\\s+'), lambda x: x <> '') AS p FROM n), f AS (SELECT p_partkey, CASE WHEN len(p) = 1 THEN p[1] WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ' ') END AS a, CASE WHEN len(p) > 1 THEN p[len(p)] END AS b FROM p) SELECT p_partkey, " + _TITLE.format("a") + " AS first_name, " + _TITLE.format("b") + " AS last_name FROM f",
    "b5_age": "SELECT o_orderkey, (2024 - year(o_orderdate) - CASE WHEN (2, 29) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END)::INT AS age FROM orders",
    "b6_client_address": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '1.1.1.' || (event_id % 256) WHEN event_id % 3 = 0 THEN '2.2.2.' || (event_id % 256) WHEN event_id % 7 <> 0 THEN '3.3.3.3' ELSE 'unknown' END AS trusted, CASE WHEN event_id % 7 <> 0 THEN '3.3.3.3' ELSE 'unknown' END AS direct FROM events",
    "b11_consent_versions": oracle("SELECT consent_version, count(*) AS n FROM profiles GROUP BY consent_version", "profiles"),
    "b12_number_checks": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS plain, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS strict FROM events",
    "b13_attack_class": "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'spoof_unknown' ELSE CASE page_id % 6 WHEN 0 THEN 'spoof_screen_replay' WHEN 1 THEN 'spoof_print_paper' WHEN 3 THEN 'spoof_unknown' ELSE 'spoof_mask_cutout' END END AS attack FROM pages",
    "b14_document_type": "SELECT page_id, ['aze_passport', 'grc_passport', 'lva_passport', 'srb_passport', NULL, 'grc_passport'][page_id % 6 + 1] AS document_type FROM pages WHERE page_id % 6 <> 4 AND page_id // 6 % 6 IN (0, 1, 5) AND page_id // 36 % 4 <> 2",
    "b15_sample_frames": "WITH f AS (SELECT doc_id, (n_chars - 200) AS c, doc_id % 7 AS n FROM documents) SELECT doc_id, CASE WHEN c <= 0 THEN '0' WHEN n <= 1 THEN floor(c * 0.5::DOUBLE)::BIGINT::VARCHAR ELSE array_to_string([floor(c * (0.2::DOUBLE + i * 0.6::DOUBLE / (n - 1)))::BIGINT for i in range(n)], ',') END AS frames, CASE WHEN c % 40 > 0 THEN array_to_string(list_sort(list_distinct([(c % 40) * r // (n + 1) for r in range(1, n + 1)])), ',') ELSE '' END AS even FROM f",
    "b18_name_tokens": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(upper(regexp_replace(regexp_replace(string_split(text, '/')[-1], '\([^)]*\)', ' ', 'g'), '[^A-Za-z<]', ' ', 'g')), ' '), lambda x: x <> ''))), ' ') AS tokens FROM documents""",
    "b19_loose_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderdate::DATE END AS parsed FROM orders",
    "b20_lighting": "WITH l AS (SELECT event_id, [((event_id * (i + 7)) % (event_id % 90 + 10)) / 100.0::DOUBLE + CASE WHEN event_id % 4 = 0 THEN 0.6::DOUBLE ELSE 0 END for i in range(16)] AS l FROM events), m AS (SELECT event_id, list_sum(l) / 16 AS mean, sqrt(greatest(list_sum([x * x for x in l]) / 16 - (list_sum(l) / 16) ** 2, 0)) AS sd, len([x for x in l if x > 0.92::DOUBLE]) / 16 AS hi, len([x for x in l if x < 0.08::DOUBLE]) / 16 AS lo FROM l) SELECT event_id, CASE WHEN mean < 0.2::DOUBLE OR lo > 0.42::DOUBLE THEN 'dark' WHEN mean > 0.82::DOUBLE OR hi > 0.36::DOUBLE THEN 'bright' WHEN sd < 0.09::DOUBLE THEN 'flat' ELSE 'good' END AS status FROM m",
}
