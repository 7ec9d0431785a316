"""Zone reading: known misreadings and what comes of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sealmark.operators import zones

AS_OF = dt.date(2024, 6, 1)
#: Invented persons: surname, given names, digits of the number, birth, sex, expiry.
LONG = ("BRANDOLIN", "CELESTINORA", "0417306", dt.date(1987, 2, 8), "M", dt.date(2033, 6, 5))
SHORT = ("TARNOWITZ", "BELIMO", "0250873", dt.date(1991, 8, 20), "M", dt.date(2029, 10, 9))
THIRD = ("QUENTAVIRE", "MOSLAHUND", "0609031", dt.date(2002, 10, 30), "M", dt.date(2034, 1, 6))
SPECIMEN = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def check(text):
    values = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return str(sum(values.get(c, 0) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10)


def short_date(day):
    return day.strftime("%y%m%d")


def first(person, begin="P<LAO", filler="<", tail=""):
    return (f"{begin}{person[0]}<<{person[1]}{tail}").ljust(44, filler)


def second(person):
    """The clean second line, to be spoiled."""
    number, birth, expiry = f"PA{person[2]}", short_date(person[3]), short_date(person[5])
    head, middle, end = number + check(number), birth + check(birth), expiry + check(expiry) + "<" * 15
    return head + "LAO" + middle + person[4] + end + check(head + middle + end)


def spoiled(line, **at):
    """line with other characters from places on: p5="OO" puts OO at place 5."""
    for place, what in at.items():
        k = int(place[1:])
        line = line[:k] + what + line[k + len(what) :]
    return line


def letters(line, a, b, table):
    return line[:a] + line[a:b].translate(str.maketrans(table)) + line[b:]


def fields(person):
    return (f"PA{person[2]}", person[0], person[1], "LAO", str(person[3]), str(person[5]), person[4])


NAME_LINES = [
    (first(SHORT, "POLAO"), SHORT), (first(SHORT, "POLAO", "K"), SHORT),
    # filler read as K with some S, which also stands at the ends of names
    (f"POLAO{SHORT[0]}S<{SHORT[1]}S" + "KKKKKSKKKKKKSKKKKKKS", SHORT),
    # a doubled P, a K of the filler that joins the name
    (f"PPOLAO{LONG[0]}<<{THIRD[1]}K<<<KKKKEKKKKKKKK", (LONG[0], THIRD[1])),
    (f"POLAO{SHORT[0]}S<{SHORT[1]}S" + "<<S<<<<<<<<<S<<<<<<<<", SHORT), (f"POLAO{SHORT[0]}S<<{SHORT[1]}S" + "<S<<<<<<<<<<<<<<<<<<", SHORT),
    ("P<UTOQUILL<<ARLO<TENNA" + "<" * 22, ("QUILL", "ARLO TENNA")), (first(LONG, tail="<X"), LONG), (first(SHORT, tail="<<<<<<<<<SS<KKKKKKKKKK"), SHORT),
]


def readings():
    """(text, what is to be read) of zones spoiled in known ways."""
    yield SPECIMEN, ("L898902C3", "ERIKSSON", "ANNA MARIA", "UTO", "1974-08-12", "2012-04-15", "F")
    digits = {"0": "O"}
    # O for 0 in all numbers, K for filler
    yield first(THIRD) + "\n" + spoiled(letters(letters(second(THIRD), 2, 10, digits), 13, 28, digits), p35="KK", p43="<"), fields(THIRD)
    # the first characters lost, the issuer read as LA0, the line cut off
    yield first(THIRD)[3:].rstrip("<") + "<\n" + spoiled(second(THIRD), p12="0")[:29], fields(THIRD)
    # the first line in two parts; the second without its series and issuer
    yield first(LONG, "POLAO")[:22] + "\n" + first(LONG, "POLAO")[22:] + "\n24" + LONG[2] + second(LONG)[9] + "00" + second(LONG)[13:28] + "<<<", fields(LONG)
    # the series and a zero lost, letters for the sex and in the expiry
    yield first(LONG, tail="<X") + "\n49" + LONG[2][1:] + second(LONG)[9] + "LA0" + spoiled(second(LONG), p20="N", p21="S")[13:28] + "<<<<", fields(LONG)
    yield first(SHORT, tail="<<<<<<<<<SS<KKKKKKKKKK") + "\n" + spoiled(letters(letters(second(SHORT), 13, 20, digits), 21, 28, digits), p2="Q", p40="2<<<"), fields(SHORT)
    yield first(LONG, tail="<X") + "\n" + second(LONG), fields(LONG)
    # B for 8, O for 0, N for the sex, and an S that is a 3 by the check digit
    yield first(LONG, "POLAO") + "\n" + spoiled(letters(letters(second(LONG), 13, 20, {"8": "B", "0": "O"}), 21, 28, digits), p20="N", p21="S"), fields(LONG)
    # a prefix that lost a character: the second line's issuer tells where the names begin
    yield first(LONG, "P<AO") + "\n" + second(LONG), fields(LONG)
    # an issuer that only the first line has
    yield first(LONG) + "\n" + spoiled(second(LONG), p10="1OO"), fields(LONG)
    # blanks between the characters, and inside the filler
    yield "\n".join(" ".join(x) for x in SPECIMEN.split("\n")), ("L898902C3", "ERIKSSON", "ANNA MARIA", "UTO", "1974-08-12", "2012-04-15", "F")
    yield SPECIMEN.replace("<<", "< <"), ("L898902C3", "ERIKSSON", "ANNA MARIA", "UTO", "1974-08-12", "2012-04-15", "F")


READINGS = list(readings())
SIDEWAYS = "RDP LAO LAO PDR\nPassport No PA0417306\nBRANDOLIN\nCELESTINORA\nNationality LAO\n08 FEB 1987\n05 JUN 2033\nPOLAOQWO XT\nPXWERQGGTTLANORA<<<\nSPQHBQNOPRUSSTSS061K3<<"


def test_names(spark):
    rows = [(i, x.ljust(44, "<")[:44]) for i, (x, _) in enumerate(NAME_LINES)]
    got = spark.createDataFrame(rows, "i int, line string").select("i", zones.names(zones.aligned(F.col("line")), F.lit("")).alias("n")).orderBy("i").collect()
    for r, (line, person) in zip(got, NAME_LINES):
        assert (r.n.surname, r.n.given_names) == person[:2], line


def test_readings(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(READINGS)], "i int, text string")
    got = zones.read_passports(df, F.lit(AS_OF)).orderBy("i").collect()
    for r, (text, want) in zip(got, READINGS):
        z = r.zone
        assert z is not None, text
        assert (z.passport_number, z.surname, z.given_names, z.nationality, str(z.date_of_birth), str(z.expiry_date), z.sex) == want, text
        assert z.valid and z.check_digits_valid and r.confidence == 0.92
        assert [s.code for s in r.signals] == (["PASSPORT_EXPIRED"] if want[3] == "UTO" else [])


def test_unread_texts(spark):
    wrong = first(LONG) + "\n" + spoiled(second(LONG), p26="6")
    texts = [None, "", "no zone", SIDEWAYS, "P<UTOSAMPLE<<ANN<<<<<<<<<<<<<<<<<<<<<<<<<<<<", wrong, "<<" + "x" * 200_000]
    got = zones.read_passports(spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, text string, zone_row string"), F.lit(AS_OF)).orderBy("i").collect()
    codes = [[s.code for s in r.signals] for r in got]
    assert codes == [["MRZ_NOT_READ"]] * 3 + [["MRZ_NOT_CONFIDENT"], ["MRZ_NOT_READ"], ["MRZ_CHECK_DIGIT_MISMATCH"], ["MRZ_NOT_READ"]]
    assert got[3].zone is None and got[5].zone.valid is False and got[5].confidence == pytest.approx(0.4)


def test_built_from_columns_alone(spark):
    plan = zones.read_passports(spark.createDataFrame([("x",)], "text string"), F.lit(AS_OF))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
