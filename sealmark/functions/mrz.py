"""Machine-readable zones as columns: check digits, dates, and TD3 fields of cleanly read lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the check digit, in turn.
WEIGHTS = (7, 3, 1)


def let(value: Column, use) -> Column:
    """use(value), computed once though `use` mentions it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def check_digit(text: Column, width: int | None = None) -> Column:
    """Sum of character values (0-9, A-Z as 10-35, else 0) by the weights, modulo 10.

    A text of known width is summed place by place, which costs far less than a walk over an array of its characters.
    """
    if width is not None:
        values = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        places = [F.greatest(F.instr(values, F.substring(text, i + 1, 1)) - 1, F.lit(0)) * WEIGHTS[i % 3] for i in range(width)]
        return (sum(places[1:], places[0]) % 10).cast("string")

    def worth(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55).otherwise(0)
        return value * F.when(i % 3 == 0, WEIGHTS[0]).when(i % 3 == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])

    return (F.aggregate(F.transform(F.split(text, ""), worth), F.lit(0), lambda a, x: a + x) % 10).cast("string")


def _date(text: Column, century: Column) -> Column:
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat((century + F.substring(text, 1, 2).try_cast("int")).cast("string"), F.substring(text, 3, 4)), "yyyyMMdd"))


def mrz_date(text: Column, as_of: Column, allow_future: bool) -> Column:
    """yyMMdd: expiry dates lie in 2000-2099; birth dates in this century up to this year, else in the last, never after as_of."""
    if allow_future:
        return _date(text, F.lit(2000))
    year = F.substring(text, 1, 2).try_cast("int")
    d = _date(text, F.when(year <= F.year(as_of) % 100, 2000).otherwise(1900))
    return F.when(d > as_of, F.add_months(d, F.lit(-1200))).otherwise(d)


def truth_date(text: Column, as_of: Column) -> Column:
    """yyMMdd of a ground truth: a year after this one lies in the last century."""
    year = F.substring(text, 1, 2).try_cast("int")
    return _date(text, F.when(2000 + year > F.year(as_of), 1900).otherwise(2000))


def td3(line1: Column, line2: Column, as_of: Column) -> Column:
    """struct of the fields of two clean 44-character lines, with the validity of the check digits."""
    cut = lambda a, b: F.substring(line2, a + 1, b - a)
    number, birth, expiry, optional = cut(0, 9), cut(13, 19), cut(21, 27), cut(28, 42)
    agrees = lambda text, width, at: check_digit(text, width) == cut(at, at + 1)
    valid = lambda text, width, at: cut(at, at + 1).rlike("[0-9]") & agrees(text, width, at)
    soft = lambda text, width, at: ~cut(at, at + 1).rlike("[0-9]") | agrees(text, width, at)
    names = F.substring(line1, 6, 39)
    part = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<<.*$", ""), "<", " "))
    surname, given = part(F.substring_index(names, "<<", 1)), part(F.regexp_replace(F.substring(names, F.length(F.substring_index(names, "<<", 1)) + 1, F.lit(39)), "^<+", ""))
    nation = F.regexp_replace(cut(10, 13), "<", "")
    issuer = F.substring(line1, 3, 3)
    form = line1.startswith("P") & (F.regexp_replace(number, "<", "") != "") & (nation != "")
    told = F.struct((valid(number, 9, 9) & valid(birth, 6, 19) & valid(expiry, 6, 27)).alias("primary"), mrz_date(expiry, as_of, True).alias("expires"), form.alias("form"))
    return let(told, lambda t: F.struct(
        F.regexp_replace(number, "<", "").alias("passport_number"), surname.alias("surname"), given.alias("given_names"),
        F.when(~nation.rlike("^[A-Z]+$") & issuer.rlike("^[A-Z]{3}$"), issuer).otherwise(nation).alias("nationality"), mrz_date(birth, as_of, False).alias("date_of_birth"), cut(20, 21).alias("sex"),
        t["expires"].alias("expiry_date"), t["form"].alias("format_valid"), t["primary"].alias("check_digits_valid"),
        (t["primary"] & soft(optional, 14, 42) & soft(F.concat(cut(0, 10), cut(13, 20), cut(21, 43)), 39, 43)).alias("all_check_digits_valid"), (t["form"] & t["primary"] & t["expires"].isNotNull()).alias("valid"),
    ))
