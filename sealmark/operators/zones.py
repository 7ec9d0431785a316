"""Machine-readable zones in OCR text, as columns: lines that may belong to a zone, repair, names, the best pair of lines.

A text's lines stay in its row as an array; nothing is shuffled. Misread letters are put right only where the zone
itself vouches for it: by check digits in numbers, by the look of the filler in names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions import mrz
from sealmark.functions import signals as sg
from sealmark.functions.columns import fresh, held
from sealmark.functions.mrz import let
from sealmark.functions.scalars import clamp

#: What a letter in a numeric place is read as.
READ_AS = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8"}
#: What it may be otherwise, when the field's check digit fails.
OR_ELSE = {"Z": "7", "S": "3", "B": "3", "G": "9", "T": "1", "E": "6"}
#: Letters in the place of the sex that are a misread M.
SEX_MISREAD = "NHW"
#: Number, birth and expiry in the second line (start, end), each followed by its check digit.
FIELDS = ((0, 9), (13, 19), (21, 27))
#: Second lines of one issuer of which the first characters, or the issuer, were lost.
SHIFTED = r"^[0-9A-Z]{2}([0-9]{8})(?:00|0O|O0|OO)([0-9]{6})([0-9])([MF<])([0-9]{6})([0-9])"
SQUEEZED = r"^([0-9]{9})(?:LA0|LAO|A09)([0-9]{6})([0-9])([A-Z<])([A-Z0-9][0-9]{5})([0-9])"
#: What a second line has where it has a date and its check digit, if it can be sound: digits, or letters read as such.
MAY_BE_SOUND = "^.{13}" + 2 * f"[0-9{''.join(sorted({*READ_AS, *OR_ELSE}))}]{{7}}."
#: What a letter in the expiry of a squeezed line is read as.
EXPIRY_READ_AS = {"S": "3", "B": "8", "O": "0", "I": "1", "L": "1"}
#: What makes a pair of lines a zone: sound, well formed, check digits right, an expiry, the second after the first; less for lines further apart and for letters that stand for filler.
WORTH = {"valid": 10.0, "format": 4.0, "digits": 3.0, "expiry": 1.0, "order": 0.4, "apart": 0.18, "filler": 0.75}
#: What makes a text look like a passport's page.
SEEN = {"passport": 0.18, "issuer": 0.16, "number": 0.18, "date": 0.16, "year": 0.08, "words": 0.16, "filler": 0.08}
WIDTH, ROUNDS, MOST_FOR_NAMES = 44, 6, 5.0
ISLAND = r"(?<=<<)[A-Z]{1,2}(?=<)|(?<=<)[A-Z]{1,2}(?=<<)"


def cut(text: Column, start: int, end: int) -> Column:
    return F.substring(text, start + 1, end - start)


def _digit(text: Column, width: int) -> Column:
    return let(text, lambda x: mrz.check_digit(x, width))


def _digits_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[0-9]"))


def _rebuilt(line: Column) -> Column:
    """A whole second line from one that lost its first characters or its issuer; null unless all check digits agree."""

    def from_groups(pattern: str, numbers, sex, expiry) -> Column:
        g = lambda k: F.regexp_extract(line, pattern, k)

        def joined(number: Column) -> Column:
            body = F.concat(F.lit("PA"), number, F.lit("LAO"), g(2), g(3), sex(g(4)), expiry(g(5)), g(6))
            return let(body, lambda b: F.when(
                _digit(cut(b, 0, 9), 9) == cut(b, 9, 10),
                F.concat(b, F.lit("<" * 15), _digit(F.concat(cut(b, 0, 10), cut(b, 13, 20), cut(b, 21, 28), F.lit("<" * 15)), 39)),
            ))

        agree = (_digit(g(2), 6) == g(3)) & (_digit(expiry(g(5)), 6) == g(6))
        return F.when(line.rlike(pattern), F.when(agree, F.coalesce(*(joined(n) for n in numbers(g(1))))))

    shifted = from_groups(SHIFTED, lambda n: [n], lambda s: s, lambda e: e)
    squeezed = from_groups(
        SQUEEZED, lambda n: [cut(n, 1, 9), F.concat(F.lit("0"), cut(n, 2, 9))], lambda s: F.when(s.isin("F", "<"), s).otherwise(F.lit("M")), lambda e: F.translate(e, "".join(EXPIRY_READ_AS), "".join(EXPIRY_READ_AS.values()))
    )
    return F.when(line.rlike(SHIFTED), shifted).otherwise(squeezed)


def _candidate(fragment: Column) -> Column:
    """The fragment as a zone line of 44 characters, null if it can't be one."""
    tidy = F.when(fragment.startswith("P"), F.concat(F.lit("P"), F.regexp_replace(cut(fragment, 1, 5), "^[O0]", "<"), F.translate(F.substring(fragment, 6, 1 << 20), "0", "O"))).otherwise(fragment)

    def whole(line: Column) -> Column:
        long = F.length(line) >= 20
        named, bare = line.contains("<<") & long, _digits_in(line) == 0
        return F.when(line.startswith("P<") & named, line).otherwise(F.coalesce(
            _rebuilt(line),
            F.when((F.length(line) >= 27) & (_digits_in(line) >= 8), line),
            F.when(line.startswith("AO") & named & bare, F.concat(F.lit("P<L"), line)),
            F.when(line.startswith("LAO") & named & bare, F.concat(F.lit("P<"), line)),
        ))

    return F.rpad(let(tidy, whole), WIDTH, "<")


def candidate_lines(text: Column) -> Column:
    """Lines that may belong to a zone, single ones first, then neighbours joined: array of 44-character strings."""
    fragments = F.filter(F.transform(F.split(F.upper(text), r"\R|[\x1C-\x1E]"), lambda x: F.regexp_replace(x, "[^A-Z0-9<]", "")), lambda x: x != "")
    joined = lambda f: F.filter(F.transform(f, lambda x, i: F.concat(x, F.get(f, i + 1))), lambda x: x.isNotNull())
    return let(fragments, lambda f: F.filter(F.transform(F.concat(f, joined(f)), _candidate), lambda x: x.isNotNull()))


def repaired(line2: Column) -> Column:
    """The second line with letters in numeric places read as digits, as far as check digits vouch for them."""
    numeric = lambda a, b: F.translate(cut(line2, a, b), "".join(READ_AS), "".join(READ_AS.values()))

    def field(start: int, end: int) -> Column:
        other = lambda i: F.element_at(F.create_map(*(F.lit(x) for pair in OR_ELSE.items() for x in pair)), F.substring(line2, i + (start + 1), F.lit(1)))

        def settled(own: Column) -> Column:
            check = numeric(end, end + 1)
            tries = F.transform(F.sequence(F.lit(0), F.lit(end - start - 1)), lambda i: F.concat(F.substring(own, F.lit(1), i), other(i), F.substring(own, i + 2, F.lit(end - start))))
            better = F.get(F.filter(tries, lambda t: t.isNotNull() & (mrz.check_digit(t, end - start) == check)), F.lit(0))
            return F.when(~check.rlike("[0-9]") | (mrz.check_digit(own, end - start) == check), own).otherwise(F.coalesce(better, own))

        # of the number, the first two places may hold letters
        return let(F.concat(cut(line2, 0, 2), numeric(2, end)) if start == 0 else numeric(start, end), settled)

    sex = F.translate(cut(line2, 20, 21), SEX_MISREAD, "M" * len(SEX_MISREAD))
    return F.concat(field(*FIELDS[0]), numeric(9, 10), cut(line2, 10, 13), field(*FIELDS[1]), numeric(19, 20), sex, field(*FIELDS[2]), numeric(27, 28), cut(line2, 28, 42), numeric(42, 44))


def aligned(line1: Column) -> Column:
    """The first line without a doubled P, where an issuer then stands in its place."""
    less = F.concat(F.substring(line1, 2, WIDTH), F.lit("<"))
    return F.when((cut(line1, 1, 2) == "P") & (cut(less, 1, 2) != "P") & cut(less, 2, 5).rlike("^[A-Z]{3}$"), less).otherwise(line1)


def _tail_letters(line1: Column) -> Column:
    """(n, letter) of the letters found three times or more where filler is to be expected, the most frequent first."""

    def counted(tail: Column) -> Column:
        letters = F.filter(F.array_distinct(F.split(tail, "")), lambda c: c.between("A", "Z"))
        counts = F.transform(letters, lambda c: F.struct((F.length(tail) - F.length(F.replace(tail, c, F.lit("")))).alias("n"), c.alias("letter")))
        return F.sort_array(F.filter(counts, lambda s: s["n"] >= 3), asc=False)

    return let(cut(line1, 24, WIDTH), counted)


def _islands(field: Column) -> Column:
    return F.array_join(F.regexp_extract_all(field, F.lit(ISLAND), F.lit(0)), "")


def n_filler_letters(line1: Column) -> Column:
    """How many letters stand for filler in the first line."""
    letters = F.concat(F.array_join(_tail_letters(line1)["letter"], ""), _islands(cut(line1, 5, WIDTH)))
    return F.size(F.filter(F.array_distinct(F.split(letters, "")), lambda c: c != ""))


def names(line1: Column, nation: Column) -> Column:
    """struct(surname, given_names) of the first line; nation, if three letters, marks where the names begin.

    Letters that an engine prints for filler are told by two signs. Sure ones: the single most frequent letter of the
    tail, and letters alone inside filler; others of the tail are likely. Filler grows into the letters that it
    encloses, which become sure when their neighbours differ from them; a sure letter before filler is filler too,
    so it may shorten a name, while likely ones are taken only in runs.
    """
    any_of = lambda letters: F.concat(F.lit("[!"), letters, F.lit("]"))  # noqa: E731 ('!' is in no line)
    known = nation.rlike("^[A-Z]{3}$")
    at = F.instr(cut(line1, 1, 8), nation)
    start = F.when(known & (at > 0), at + 3).when(known & (cut(line1, 2, 5) != nation) & (cut(line1, 2, 4) == F.substring(nation, 2, 2)), 4).otherwise(5)
    field = F.substring(line1, start + 1, F.lit(WIDTH))

    def begun(field: Column) -> Column:
        def told(tail: Column) -> Column:
            first, second = F.get(tail, F.lit(0)), F.get(tail, F.lit(1))
            lone = F.when(first["n"] > F.coalesce(second["n"], F.lit(0)), first["letter"]).otherwise("")
            sure = F.concat(F.coalesce(lone, F.lit("")), _islands(field))
            return let(sure, lambda s: F.struct(field.alias("field"), s.alias("sure"), F.concat(s, F.array_join(tail["letter"], "")).alias("filler")))

        return let(let(_tail_letters(line1), told), lambda t: F.struct(t["field"].alias("field"), t["sure"].alias("sure"), t["filler"].alias("filler"), (t["filler"] == "").alias("done")))

    def grown(s: Column, _) -> Column:
        return F.when(s["done"], s).otherwise(let(round_of(s), lambda t: F.struct(t["field"].alias("field"), t["sure"].alias("sure"), t["filler"].alias("filler"), (t["field"] == s["field"]).alias("done"))))

    def round_of(s: Column) -> Column:
        enclosed = F.array_join(F.regexp_extract_all(s["field"], F.concat(F.lit("(?=("), any_of(s["filler"]), F.lit(r")(?!\1)([A-Z])(?!\2)(?:[<!"), s["filler"], F.lit("]|$))")), F.lit(2)), "")
        return let(F.struct(s["field"].alias("field"), F.concat(s["sure"], enclosed).alias("sure"), F.concat(s["filler"], enclosed).alias("filler"), s["filler"].alias("before")), lambda t: F.struct(
            F.regexp_replace(
                F.regexp_replace(t["field"], F.concat(F.lit("(?<="), any_of(t["before"]), F.lit(")[A-Z](?=[<!"), t["before"], F.lit("]|$)")), F.lit("<")),
                F.concat(any_of(t["sure"]), F.lit("(?=[<!"), t["filler"], F.lit("])")), F.lit("<"),
            ).alias("field"), t["sure"].alias("sure"), t["filler"].alias("filler"),
        ))

    def split(s: Column) -> Column:
        plain = F.regexp_replace(s["field"], F.concat(any_of(s["filler"]), F.lit("{2,}")), F.lit("<<"))
        dirty = s["filler"] != ""

        def parts(plain: Column) -> Column:
            first = F.substring_index(plain, "<<", 1)
            second = F.substring(plain, F.length(first) + 3, F.lit(WIDTH))
            # one half of the separator was lost: names are parted by the first single one
            lost = dirty & (F.trim(second, F.lit("<")) == "") & F.trim(first, F.lit("<")).contains("<")
            head = F.substring_index(first, "<", 1)
            return F.struct(F.when(lost, head).otherwise(first).alias("surname"), F.when(lost, F.substring(first, F.length(head) + 2, F.lit(WIDTH))).otherwise(second).alias("given"))

        def clean(part: Column) -> Column:
            tokens = F.filter(F.split(F.substring_index(part, "<<", 1), "<"), lambda t: t != "")
            tokens = let(tokens, lambda t: F.when((F.size(t) > 1) & (F.length(F.element_at(t, -1)) == 1), F.slice(t, 1, F.size(t) - 1)).otherwise(t))
            return F.array_join(F.filter(tokens, lambda t: ~F.rlike(t, F.concat(F.lit("^"), any_of(s["filler"]), F.lit("+$")))), " ")

        return let(let(plain, parts), lambda p: F.struct(clean(p["surname"]).alias("surname"), clean(F.ltrim(p["given"], F.lit("<"))).alias("given_names")))

    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), let(field, begun), grown)
    return let(state, split)


def best_pair(lines: Column, as_of: Column) -> Column:
    """The pair of lines that reads best as a zone, with its fields; null if none does.

    A pair's names add MOST_FOR_NAMES to its score at most, so they are looked for only where they can decide, and
    once for pairs that would read the same names.
    """
    firsts = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
        lambda s: s["line"].rlike("^P[A-Z<]") & s["line"].contains("<<") & (_digits_in(s["line"]) <= 5),
    )
    firsts = F.transform(firsts, lambda s: let(aligned(s["line"]), lambda x: F.struct(s["i"].alias("i"), x.alias("line"), n_filler_letters(x).alias("filler"))))
    no_issuer = F.lit("P".ljust(WIDTH, "<"))
    # a sound second line beats any other for the same first line, so others are read only where there is none
    numbered = F.transform(lines, lambda x, j: F.struct(j.alias("j"), x.alias("line")))
    read = lambda rows: F.transform(rows, lambda s: F.struct(s["j"].alias("j"), s["line"].alias("line"), let(repaired(s["line"]), lambda r: mrz.td3(no_issuer, r, as_of)).alias("z")))
    sound_ones = F.filter(read(F.filter(numbered, lambda s: s["line"].rlike(MAY_BE_SOUND))), lambda s: s["z"]["valid"])
    seconds = let(sound_ones, lambda s: F.when(F.size(s) > 0, s).otherwise(read(numbered)))
    worth = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)

    def met(a: Column, b: Column) -> Column:
        z, issuer = b["z"], cut(a["line"], 2, 5)
        sound = (
            worth(z["valid"], WORTH["valid"]) + worth(z["format_valid"], WORTH["format"]) + worth(z["check_digits_valid"], WORTH["digits"]) + worth(z["expiry_date"].isNotNull(), WORTH["expiry"]) + worth(b["j"] > a["i"], WORTH["order"])
            + F.greatest(F.lit(0.0), 1.0 - F.abs(b["j"] - a["i"] - 1) * WORTH["apart"])
        )
        nation = F.when(~z["nationality"].rlike("^[A-Z]+$") & issuer.rlike("^[A-Z]{3}$"), issuer).otherwise(z["nationality"])
        return F.struct(a.alias("a"), b.alias("b"), sound.alias("sound"), (sound - a["filler"] * WORTH["filler"]).alias("before"), nation.alias("nation"))

    def judged(p: Column) -> Column:
        a, b, z = p["a"], p["b"], p["b"]["z"]

        def with_names(n: Column) -> Column:
            full = F.concat_ws(" ", F.nullif(n["given_names"], F.lit("")), F.nullif(n["surname"], F.lit("")))
            score = p["sound"] + F.least(F.length(full) / 5.0, F.lit(MOST_FOR_NAMES)) - a["filler"] * WORTH["filler"]
            kept = ("date_of_birth", "sex", "expiry_date", "format_valid", "check_digits_valid", "valid")
            return F.struct(
                score.alias("score"), a["i"].alias("i"), b["j"].alias("j"), z["passport_number"].alias("passport_number"), n["surname"].alias("surname"), n["given_names"].alias("given_names"),
                p["nation"].alias("nationality"), *(z[c].alias(c) for c in kept), F.concat(a["line"], F.lit("\n"), b["line"]).alias("mrz_text"),
            )

        return let(names(a["line"], p["nation"]), with_names)

    pairs = let(seconds, lambda s: F.flatten(F.transform(firsts, lambda a: F.transform(F.filter(s, lambda b: b["j"] != a["i"]), lambda b: met(a, b)))))
    hopeful = let(pairs, lambda p: let(F.array_max(F.transform(p, lambda x: x["before"])), lambda top: F.filter(p, lambda x: x["before"] + MOST_FOR_NAMES + 1e-6 >= top)))
    place = lambda x: F.struct(x["before"].alias("s"), x["a"]["i"].alias("i"), x["b"]["j"].alias("j"))
    beaten = lambda x, y: (y["a"]["line"] == x["a"]["line"]) & (y["nation"] == x["nation"]) & (place(y) > place(x))
    hopeful = let(hopeful, lambda p: F.filter(p, lambda x: ~F.exists(p, lambda y: beaten(x, y))))
    return let(F.array_max(F.transform(hopeful, judged)), lambda p: F.when(p["score"] > 0, p.dropFields("score", "i", "j")))


def evidence(text: Column) -> Column:
    """How much a text looks like a passport's page when its zone wasn't read, 0 to 1."""
    plain = F.regexp_replace(F.upper(text), "[^A-Z0-9< ]", " ")
    compact = F.regexp_replace(plain, r"\s+", "")
    month = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
    worth = lambda c, w: F.when(c, w).otherwise(0.0)
    tokens = F.size(F.filter(F.regexp_extract_all(plain, F.lit(r"\b([A-Z]{5,})\b"), F.lit(1)), lambda t: ~t.isin("PASSPORT", "NATIONALITY", "AUTHORITY")))
    return clamp(
        worth(plain.rlike("PASSPORT|PDR"), SEEN["passport"]) + worth(plain.contains("LAO"), SEEN["issuer"]) + worth(compact.rlike("P[A-Z0-9][0-9O]{5,8}"), SEEN["number"])
        + worth(plain.rlike(rf"[0-3][0-9]\s*{month}\s*(19|20)[0-9]{{2}}"), SEEN["date"]) + worth(plain.rlike("(19|20)[0-9]{2}") & plain.rlike(month), SEEN["year"]) + worth(tokens >= 2, SEEN["words"])
        + worth(F.contains(text, F.lit("<<")) | compact.startswith("P") | compact.rlike("P[O<]LAO"), SEEN["filler"])
    )


def read_passports(texts: DataFrame, as_of: Column, text: str = "text") -> DataFrame:
    """texts with `zone` (null where none was read), `signals` and `confidence`. Null text: nothing read."""
    value = F.col(text)
    # two marks of the filler side by side, once what no zone has is taken out
    maybe = F.coalesce(F.upper(value).rlike("<[^A-Z0-9<]*+<"), F.lit(False))
    zone = F.when(maybe, let(candidate_lines(value), lambda x: best_pair(x, as_of)))
    kept, name = [c for c in texts.columns if c not in ("zone", "signals", "confidence")], fresh("zone_row", texts)
    out = held(texts, name, kept, zone=zone).select(*kept, f"{name}.zone")
    z, none = F.col("zone"), F.col("zone").isNull()
    seen = evidence(F.coalesce(value, F.lit(""))) >= 0.65
    found = sg.ladder(
        [(none & seen, "MRZ_NOT_CONFIDENT", "medium", 0.28), (none, "MRZ_NOT_READ", "high", 0.82), (~z["format_valid"], "MRZ_INVALID", "medium", 0.42), (~z["check_digits_valid"], "MRZ_CHECK_DIGIT_MISMATCH", "medium", 0.34)],
        (z["expiry_date"] <= as_of, "PASSPORT_EXPIRED", "high", 0.95),
    )
    confidence = F.when(none & seen, 0.28).when(none, 0.0).when(z["valid"], 0.92).otherwise(0.4)
    return out.withColumns({"signals": found, "confidence": confidence})
