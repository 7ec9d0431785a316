"""Queries over document text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sealmark.functions import mrz
from sealmark.functions import signals as sg
from sealmark.operators import documents, zones
from sealmark.plans.bindings import table

AS_OF = date(2024, 6, 1)


def _customers(spark, sf):
    """Customers dealt over all cores: the table has few files, but its rows are much work each."""
    return table(spark, sf, "customer").repartition(spark.sparkContext.defaultParallelism)


def _zones(spark, sf):
    """A clean zone per customer, from the key; with the market segment."""
    k = F.col("c_custkey")
    number = F.rpad(F.concat(F.lit("T"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")), 9, "<")
    birth = F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 29000).cast("int")), "yyMMdd")
    expiry = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k * 11 % 4000).cast("int")), "yyMMdd")
    word = F.regexp_replace(F.upper(F.col("c_mktsegment")), "[^A-Z]", "")
    line1 = F.rpad(F.concat(F.lit("P<UTO"), F.translate(F.lpad((k % 1000).cast("string"), 3, "0"), "0123456789", "ABCDEFGHIJ"), word, F.lit("<<KIM<"), F.translate((k % 50).cast("string"), "0123456789", "KLMNOPQRST")), 44, "<")
    rows = _customers(spark, sf).select("c_custkey", "c_mktsegment", line1.alias("line1"), number.alias("number"), birth.alias("birth"), expiry.alias("expiry"))
    digit = lambda text, width: mrz.let(text, lambda x: mrz.check_digit(x, width))
    checked = lambda text, width: F.concat(text, digit(F.col(text), width))
    body = rows.select("*", checked("number", 9).alias("head"), checked("birth", 6).alias("mid"), checked("expiry", 6).alias("end"))
    # filler adds nothing to a sum, so the last digit needs the places before it alone
    line2 = F.concat("head", F.lit("UTO"), "mid", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M"), "end", F.lit("<" * 15))
    return body.select("c_custkey", "c_mktsegment", "line1", F.concat(line2, digit(F.concat("head", "mid", "end"), 24)).alias("line2"))


def k1_check_digits(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", mrz.check_digit(F.upper(F.regexp_replace("c_name", "#", "<"))).alias("digit"))


def k3_td3_fields(spark, sf):
    z = _zones(spark, sf).select("c_custkey", mrz.td3(F.col("line1"), F.col("line2"), F.lit(AS_OF)).alias("z"))
    return z.select("c_custkey", "z.*").drop("format_valid")


def k6_mrz_dates(spark, sf):
    text = F.date_format("o_orderdate", "yyMMdd")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.substring(text, 1, 2), F.lit("0231"))).when(F.col("o_orderkey") % 10 == 1, F.lit("9A0101")).when(F.col("o_orderkey") % 10 == 2, F.lit("241231")).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", mrz.mrz_date(text, F.lit(AS_OF), False).alias("birth"), mrz.mrz_date(text, F.lit(AS_OF), True).alias("expiry"))


def _damaged(spark, sf, **more):
    """Zones as an engine reads them: digits as letters, filler as K, lines cut in two, a doubled P, wrong check digits. more: columns of clean zones to go with them."""
    k = F.col("c_custkey")
    given = F.regexp_replace("line1", "<<KIM<([K-T]+)<.*$", "<<KIMA<VA$1")
    line1 = F.rpad(given, 44, "<")
    l1 = F.when(k % 5 == 1, F.rpad(given, 44, "K")).when(k % 5 == 3, F.concat(F.lit("P"), F.substring(line1, 1, 43))).otherwise(line1)
    part = lambda a, b: F.substring("line2", a + 1, b - a)
    misread = lambda a, b: F.translate(part(a, b), "05", "OS")
    l2 = F.when(k % 7 == 1, F.concat(part(0, 2), misread(2, 10), part(10, 13), misread(13, 20), part(20, 21), misread(21, 28), part(28, 44)))
    l2 = l2.when(k % 7 == 2, F.concat(part(0, 9), ((part(9, 10).cast("int") + 1) % 10).cast("string"), part(10, 44)))
    l2 = l2.when(k % 7 == 3, F.concat(part(0, 21), F.regexp_replace(part(21, 27), "^([^3]*)3", "$1S"), part(27, 44))).when(k % 7 == 4, F.concat(part(0, 10), F.lit("1T0"), part(13, 44)))
    l2 = l2.when(k % 7 == 5, F.concat(part(0, 20), F.translate(part(20, 21), "M", "N"), part(21, 44))).otherwise(F.col("line2"))
    return _zones(spark, sf).select("c_custkey", l1.alias("line1"), l2.alias("line2"), *(c.alias(n) for n, c in more.items()))


def damaged_texts(spark, sf, **more):
    k = F.col("c_custkey")
    l1 = F.when(k % 5 == 2, F.concat(F.substring("line1", 1, 30), F.lit("\n"), F.substring("line1", 31, 14))).otherwise(F.col("line1"))
    text = F.when(k % 11 == 0, F.lit("nothing to read here")).otherwise(F.concat(F.lit("PASSPORT\n"), l1, F.lit("\n"), F.col("line2"), F.lit("\n")))
    rows = _damaged(spark, sf, **more).repartition(spark.sparkContext.defaultParallelism)  # made before the work on them
    return rows.select("c_custkey", *more, F.explode(F.array(text)).alias("text"))  # made once, read often


def k2_candidate_lines(spark, sf):
    return damaged_texts(spark, sf).select("c_custkey", F.posexplode(zones.candidate_lines(F.col("text"))).alias("nr", "line"))


def k4_repaired_lines(spark, sf):
    return _damaged(spark, sf).select("c_custkey", zones.repaired(F.col("line2")).alias("line2"))


def k5_names(spark, sf):
    return _damaged(spark, sf).select("c_custkey", zones.names(zones.aligned(F.col("line1")), F.lit("UTO")).alias("n")).select("c_custkey", "n.*")


def k8_mrz_outcome(spark, sf):
    out = zones.read_passports(damaged_texts(spark, sf), F.lit(AS_OF))
    fields = ("passport_number", "surname", "given_names", "nationality", "sex", "date_of_birth", "expiry_date", "valid")
    return out.select("c_custkey", *(f"zone.{f}" for f in fields), sg.codes(F.col("signals")).alias("codes"), "confidence")


def truth_text(given="<<KIM<"):
    """The truth file of a customer's clean zone: two in three with zone lines (and printed fields that say otherwise), others printed alone, in two scripts."""
    k = F.col("c_custkey")
    word = F.regexp_replace(F.upper(F.col("c_mktsegment")), "[^A-Z]", "")
    printed = F.concat(
        F.lit("Passport Number: x 12"), k.cast("string"), F.lit("\nSurname/Family Name: 张 (alias) / "), word, F.lit("-LEE,TAN\nGiven Name/First Name: "), F.when(k % 2 == 0, "").otherwise("An Na"),
        F.lit("\nCountry Code: uto \nDate of Birth: 0"), (k % 9 + 1).cast("string"), F.lit(" Mar / 1990\nGender/Sex: "), F.when(k % 4 == 1, "女 / F").when(k % 4 == 3, "Male").otherwise("?"), F.lit("\nExpired Date: 2031-12-2"), (k % 10).cast("string"), F.lit("\n"),
    )
    zone = F.concat(F.lit("MRZ Lines:\n P<SHORT \n  "), F.rpad(F.regexp_replace(F.rtrim("line1", F.lit("<")), "<<KIM<", given), 44, "<"), F.lit("  \n"), "line2", F.lit("\n"))
    return F.concat(printed, F.when(k % 3 != 0, zone).otherwise("MRZ Lines:\nP<UTO\n"))


def k9_truth_fields(spark, sf):
    files = _zones(spark, sf).select("c_custkey", truth_text().alias("text"))
    return documents.truth_fields(files, F.lit(AS_OF)).drop("text")


def k10_id_cards(spark, sf):
    """ID cards of eight kinds, by the key: labelled, names under labels, Lao script, no number, spaced dates with letters, month names, numbers alone, hardly anything."""
    k = F.col("c_custkey")
    word = F.regexp_replace(F.upper(F.col("c_mktsegment")), "[^A-Z]", "")
    day, expires = F.date_add(F.lit("1960-01-01").cast("date"), (k % 15000).cast("int")), F.date_add(F.lit("2020-01-01").cast("date"), (k * 13 % 5000).cast("int"))
    as_text = lambda d, form: F.date_format(d, form)
    nr9 = F.lpad((k * 104729 % 1000000000).cast("string"), 9, "3")
    rows = lambda *x: F.concat_ws("\n", *(F.lit(y) if isinstance(y, str) else y for y in x))
    say = lambda head, x: F.concat(F.lit(head), x)
    letters = lambda c: F.translate(c, "015", "OIS")
    kinds = [
        rows("LAO NATIONAL ID CARD", say("ID NO ", F.concat(F.lit("123"), nr9)), F.concat(F.lit("NAME "), word, F.lit(" TESTER")), "NATIONALITY LAO", say("DATE OF BIRTH ", as_text(day, "dd/MM/yyyy")), say("EXPIRY ", as_text(expires, "dd-MM-yyyy"))),
        rows("Nom / Surname", word, "Prenoms / Given names", "Anna-Lu", say("NO ", nr9), say("Date of birth ", as_text(day, "d/M/yyyy")), say("Valid to ", as_text(expires, "yyyy.MM.dd"))),
        rows(say("ເລກທີ 10-", F.substring(nr9, 1, 7)), "ຊື່ແລະນາມສະກຸນ ສົມໄຊ  ສີສຸວັນ", say("ວັນເກີດ ", as_text(day, "dd/MM/yyyy")), say("ບັດໝົດອາຍຸ ", as_text(F.lit("2031-05-24").cast("date"), "dd/MM/yyyy"))),
        rows("LAO NATIONAL ID CARD", say("FAMILY NAME ", word), "FIRST NAME", "BOUN"),
        rows(say("NO ", F.concat(nr9, F.lit("123456"))), say("CARD ", F.lit("1234567")), say("", letters(as_text(day, "dd / MM / yyyy"))), say("", letters(as_text(F.lit("2032-10-15").cast("date"), "dd / MM / yyyy")))),
        rows("IDENTITY CARD", "MR", word, "SOMPHET", say("NUMBER ", F.concat(F.substring(nr9, 1, 3), F.lit(" "), F.substring(nr9, 4, 3), F.lit("-"), F.substring(nr9, 7, 3))), say("DOB ", F.upper(as_text(day, "d MMM yyyy"))), say("EXPIRE ", as_text(expires, "yyyy-MM-dd"))),
        rows(nr9, as_text(day, "dd.MM.yyyy"), as_text(F.lit("2023-05-24").cast("date"), "dd.MM.yyyy"), "31/02/2030"),
        F.when(k % 16 == 7, F.lit("12/3 q")).otherwise("card 12/3"),
    ]
    text = F.element_at(F.array(*kinds), (k % 8 + 1).cast("int"))
    out = documents.read_id_cards(_customers(spark, sf).select("c_custkey", text.alias("text")), AS_OF)
    return out.select("c_custkey", "number", "date_of_birth", "expiry_date", "full_name", "nationality", F.concat_ws(",", "keywords").alias("keywords"), F.round("confidence", 4).alias("confidence"), sg.codes(F.col("signals")).alias("codes"))


QUERIES = [k1_check_digits, k2_candidate_lines, k3_td3_fields, k4_repaired_lines, k5_names, k6_mrz_dates, k8_mrz_outcome, k9_truth_fields, k10_id_cards]

_CD = "CAST(list_sum([greatest(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({0}, i, 1)) - 1, 0) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, length({0}) + 1)]) % 10 AS VARCHAR)"
ZONES = f"""WITH a AS (SELECT c_custkey, rpad('T' || lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0'), 9, '<') AS number, DATE '1940-01-01' + (c_custkey * 37 % 29000)::INT AS born, DATE '2020-01-01' + (c_custkey * 11 % 4000)::INT AS expires,
 translate(lpad((c_custkey % 1000)::VARCHAR, 3, '0'), '0123456789', 'ABCDEFGHIJ') || regexp_replace(upper(c_mktsegment), '[^A-Z]', '', 'g') AS surname, 'KIM ' || translate((c_custkey % 50)::VARCHAR, '0123456789', 'KLMNOPQRST') AS given FROM customer)
"""
#: The zones of customers as they were before they were damaged, and what can still be read of them.
CLEAN = ZONES[:-1] + f""", b AS (SELECT *, c_custkey % 5 AS m5, c_custkey % 7 AS m7, c_custkey % 11 = 0 AS blank, strftime(born, '%y%m%d') AS b6, strftime(expires, '%y%m%d') AS e6,
 'VA' || split_part(given, ' ', 2) AS second, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM a),
c AS (SELECT *, number || {_CD.format("number")} AS head, b6 || {_CD.format("b6")} AS mid, e6 || {_CD.format("e6")} || repeat('<', 15) AS tail FROM b),
d AS (SELECT *, head || 'UTO' || mid || sex || tail || {_CD.format("(head || mid || tail)")} AS l2,
 'P<UTO' || surname || '<<KIMA<' || second AS stem, ((substr(head, 10, 1)::INT + 1) % 10)::VARCHAR AS wrong FROM c),
z AS (SELECT *, CASE m5 WHEN 1 THEN rpad(stem, 44, 'K') WHEN 3 THEN 'P' || substr(rpad(stem, 44, '<'), 1, 43) ELSE rpad(stem, 44, '<') END AS seen1,
 CASE m7 WHEN 1 THEN substr(l2, 1, 2) || translate(substr(l2, 3, 8), '05', 'OS') || 'UTO' || translate(substr(l2, 14, 7), '05', 'OS') || sex || translate(substr(l2, 22, 7), '05', 'OS') || substr(l2, 29)
  WHEN 2 THEN substr(l2, 1, 9) || wrong || substr(l2, 11) WHEN 3 THEN substr(l2, 1, 21) || regexp_replace(e6, '3', 'S') || substr(l2, 28) WHEN 4 THEN substr(l2, 1, 10) || '1T0' || substr(l2, 14)
  WHEN 5 THEN substr(l2, 1, 20) || replace(sex, 'M', 'N') || substr(l2, 22) ELSE l2 END AS seen2,
 'KIMA ' || CASE m5 WHEN 1 THEN rtrim(second, 'K') ELSE second END AS read_given FROM d)
"""
_KEPT = """CASE WHEN x LIKE 'P<%' AND length(x) >= 20 AND contains(x, '<<') THEN x WHEN length(x) >= 27 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8 THEN x END"""
SQL = {
    "k2_candidate_lines": CLEAN + f""", t AS (SELECT c_custkey, CASE WHEN blank THEN 'nothing to read here' ELSE 'PASSPORT' || chr(10) || CASE m5 WHEN 2 THEN substr(seen1, 1, 30) || chr(10) || substr(seen1, 31) ELSE seen1 END || chr(10) || seen2 || chr(10) END AS text FROM z),
f AS (SELECT c_custkey, list_filter(list_transform(string_split(upper(text), chr(10)), lambda x: regexp_replace(x, '[^A-Z0-9<]', '', 'g')), lambda x: x <> '') AS f FROM t),
g AS (SELECT c_custkey, unnest(f || [f[i] || f[i + 1] for i in range(1, len(f))]) AS x, unnest(range(0, 2 * len(f) - 1)) AS i FROM f),
h AS (SELECT c_custkey, i, CASE WHEN x LIKE 'P%' THEN 'P' || regexp_replace(substr(x, 2, 4), '^[O0]', '<') || replace(substr(x, 6), '0', 'O') ELSE x END AS x FROM g)
SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1)::INT AS nr, rpad({_KEPT}, 44, '<') AS line FROM h WHERE {_KEPT} IS NOT NULL""",
    "k4_repaired_lines": CLEAN + "SELECT c_custkey, CASE m7 WHEN 2 THEN seen2 WHEN 4 THEN seen2 WHEN 5 THEN l2 ELSE l2 END AS line2 FROM z",
    "k5_names": CLEAN + "SELECT c_custkey, surname, read_given AS given_names FROM z",
    "k8_mrz_outcome": CLEAN + """SELECT c_custkey, CASE WHEN NOT blank THEN replace(number, '<', '') END AS passport_number, CASE WHEN NOT blank THEN surname END AS surname, CASE WHEN NOT blank THEN read_given END AS given_names,
 CASE WHEN NOT blank THEN 'UTO' END AS nationality, CASE WHEN NOT blank THEN sex END AS sex, CASE WHEN NOT blank THEN born END AS date_of_birth, CASE WHEN NOT blank THEN expires END AS expiry_date, CASE WHEN NOT blank THEN m7 <> 2 END AS valid,
 CASE WHEN blank THEN 'MRZ_NOT_READ' ELSE concat_ws('|', CASE WHEN m7 = 2 THEN 'MRZ_CHECK_DIGIT_MISMATCH' END, CASE WHEN expires <= DATE '2024-06-01' THEN 'PASSPORT_EXPIRED' END) END AS codes,
 CASE WHEN blank THEN 0.0 WHEN m7 = 2 THEN 0.4 ELSE 0.92 END::DOUBLE AS confidence FROM z""",
    "k9_truth_fields": ZONES + f""", b AS (SELECT a.*, strftime(born, '%y%m%d') AS b6, strftime(expires, '%y%m%d') AS e6, CASE WHEN a.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, a.c_custkey % 3 <> 0 AS zone, substr(surname, 4) AS word FROM a),
c AS (SELECT *, number || {_CD.format("number")} AS head, b6 || {_CD.format("b6")} AS mid, e6 || {_CD.format("e6")} || repeat('<', 15) AS tail FROM b)
SELECT c_custkey, CASE WHEN zone THEN rtrim(number, '<') ELSE 'X12' || c_custkey END AS passport_number, CASE WHEN zone THEN surname ELSE word || ' LEE TAN' END AS surname,
 CASE WHEN zone THEN given WHEN c_custkey % 2 = 1 THEN 'AN NA' ELSE 'COUNTRY CODE UTO' END AS given_names, 'UTO' AS nationality, CASE WHEN zone THEN born ELSE make_date(1990, 3, c_custkey % 9 + 1) END AS date_of_birth,
 CASE WHEN zone THEN sex WHEN c_custkey % 4 = 1 THEN 'F' WHEN c_custkey % 4 = 3 THEN 'M' END AS sex, CASE WHEN zone THEN expires ELSE make_date(2031, 12, 20 + c_custkey % 10) END AS expiry_date,
 CASE WHEN zone THEN rpad('P<UTO' || surname || '<<' || replace(given, ' ', '<'), 44, '<') END AS mrz_line1, CASE WHEN zone THEN head || 'UTO' || mid || sex || tail || {_CD.format("(head || mid || tail)")} END AS mrz_line2 FROM c""",
    # what each kind of card says, and the confidence that follows from the fields that it has
    "k10_id_cards": """WITH c AS (SELECT c_custkey, c_custkey % 8 AS kind, regexp_replace(upper(c_mktsegment), '[^A-Z]', '', 'g') AS word, DATE '1960-01-01' + (c_custkey % 15000)::INT AS born, DATE '2020-01-01' + (c_custkey * 13 % 5000)::INT AS expires,
 lpad((c_custkey * 104729 % 1000000000)::VARCHAR, 9, '3') AS nr9 FROM customer),
r AS (SELECT c_custkey, kind, CASE kind WHEN 0 THEN '123' || nr9 WHEN 1 THEN nr9 WHEN 2 THEN '10' || substr(nr9, 1, 7) WHEN 4 THEN nr9 || '123456' WHEN 5 THEN nr9 WHEN 6 THEN nr9 END AS number,
 CASE WHEN kind IN (0, 1, 2, 4, 5, 6) THEN born END AS date_of_birth, CASE WHEN kind IN (0, 1, 5) THEN expires WHEN kind = 2 THEN DATE '2031-05-24' WHEN kind = 4 THEN DATE '2032-10-15' END AS expiry_date,
 CASE kind WHEN 0 THEN word || ' TESTER' WHEN 1 THEN word || ' ANNA-LU' WHEN 2 THEN 'ສົມໄຊ ສີສຸວັນ' WHEN 3 THEN word || ' BOUN' WHEN 4 THEN trim(regexp_replace(translate(strftime(born, '%d / %m / %Y'), '015', 'OIS'), '[^A-Z]+', ' ', 'g')) WHEN 5 THEN word || ' SOMPHET' END AS full_name,
 CASE WHEN kind IN (0, 3) THEN 'LAO' END AS nationality,
 CASE kind WHEN 0 THEN 'BIRTH,CARD,DATE,EXPIRY,ID,LAO,NAME,NATIONAL' WHEN 1 THEN 'BIRTH,DATE,GIVEN,ID,NAME,SURNAME' WHEN 3 THEN 'CARD,ID,LAO,NAME,NATIONAL' WHEN 4 THEN 'CARD' WHEN 5 THEN 'CARD,DOB,EXPIRE,ID,IDENTITY'
  WHEN 7 THEN CASE WHEN c_custkey % 16 = 7 THEN '' ELSE 'CARD' END ELSE '' END AS keywords FROM c)
SELECT c_custkey, number, date_of_birth, expiry_date, full_name, nationality, keywords, [1.0, 1.0, 0.81, 0.62, 0.88, 1.0, 0.59, CASE WHEN keywords = '' THEN 0.15 ELSE 0.22 END][kind + 1]::DOUBLE AS confidence,
 CASE WHEN kind = 3 THEN 'LAO_ID_NUMBER_NOT_READ' WHEN kind = 7 THEN CASE WHEN keywords = '' THEN 'LAO_ID_NOT_RECOGNIZED' ELSE 'LAO_ID_TEXT_WEAK' END || '|LAO_ID_NUMBER_NOT_READ' WHEN expiry_date <= DATE '2024-06-01' THEN 'LAO_ID_EXPIRED' ELSE '' END AS codes FROM r""",
    "k1_check_digits": "SELECT c_custkey, " + _CD.format("n") + " AS digit FROM (SELECT c_custkey, upper(replace(c_name, '#', '<')) AS n FROM customer)",
    "k3_td3_fields": ZONES + """SELECT c_custkey, replace(number, '<', '') AS passport_number, surname, given AS given_names, 'UTO' AS nationality, CASE WHEN year(born) >= 2025 - 1 AND born > DATE '2024-06-01' THEN born - INTERVAL 100 YEAR ELSE born END::DATE AS date_of_birth,
 CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, expires AS expiry_date, true AS check_digits_valid, true AS all_check_digits_valid, true AS valid FROM a""",
    "k6_mrz_dates": """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 10 AS m FROM orders) SELECT o_orderkey, CASE m WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN DATE '1924-12-31' ELSE make_date(CASE WHEN year(d) % 100 <= 24 THEN 2000 ELSE 1900 END + year(d) % 100, month(d), day(d)) END AS birth,
 CASE m WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN DATE '2024-12-31' ELSE make_date(2000 + year(d) % 100, month(d), day(d)) END AS expiry FROM t""",
}
