"""Personal data in texts: expressions propose spans, validators confirm them, words nearby adjust their score.

Built-in functions only. Expressions are written so that they take time linear in a text: a proposal starts where no
longer one could have started, and repeats are possessive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions.columns import fresh
from sealmark.llm.columns import computed_once, matches, running, with_value

#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: What a word of support adds to a score, and a contrary word takes off.
SUPPORT = 20
#: Length of an account number (IBAN) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_parts(s: Column) -> Column:
    """An address whose parts are at most 255."""
    return F.forall(F.split(s["value"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.ltrim(p, F.lit("0")).try_cast("int").isNull() | (F.ltrim(p, F.lit("0")).try_cast("int") <= 255)))


def luhn(s: Column) -> Column:
    """A card number of 13 to 19 digits with a right check digit."""
    return with_value(_digits(s["value"]), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def dialled(s: Column) -> Column:
    return F.length(_digits(s["value"])).between(9, 15)


def mod97(bare: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters put last, letters counting 10 to 35."""
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(48, 57), (acc * 10 + code - 48) % 97).when(code.between(65, 90), (acc * 100 + code - 55) % 97).otherwise(acc)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def account(s: Column) -> Column:
    """The proposal cut to its country's length; null where that isn't a whole number with the right remainder."""
    value = s["value"]
    size = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.substring(value, 1, 2))
    head = F.regexp_substr(value, F.concat(F.lit("^(?:\\x20?[A-Z0-9]){"), size.cast("string"), F.lit("}(?![A-Z0-9])")))
    alone = ~s["before"].rlike("[A-Za-z0-9]$") & ((F.length(head) < F.length(value)) | ~s["after"].rlike("^[A-Za-z0-9]"))
    return F.when(alone & (mod97(F.replace(head, F.lit(" "), F.lit(""))) == 1), head)


def social(s: Column) -> Column:
    """A social security number of a kind that is given out."""
    v = s["value"]
    return ~v.rlike("^(000|666|9)|-00-|0000$") & ~s["before"].rlike("[A-Za-z0-9-]$") & ~s["after"].rlike("^[A-Za-z0-9-]")


@dataclass(frozen=True)
class Kind:
    """Matches of `pattern` that `confirm` admits, in texts that `hint` matches.

    `score` is a percentage before context; words of `good` near the span raise it, words of `bad` lower it. A kind
    that is not `sure` is reported from a least score on. `cut` gives the part of a proposal that counts.
    """

    name: str
    pattern: str
    hint: str
    score: int
    good: tuple[str, ...]
    bad: tuple[str, ...]
    confirm: Callable[[Column], Column] | None = None
    cut: Callable[[Column], Column] | None = None
    sure: bool = True


#: The first four are the base. An address part, a number or a chain of digits is only begun where it isn't being
#: continued, or where the match before ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90, ("mail", "email", "contact", "write"), ("path", "handle")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 60, ("ip", "address", "host", "server", "login"), ("version", "release", "section", "build"), small_parts),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", 80, ("card", "visa", "credit", "debit", "payment"), ("order", "tracking", "serial", "invoice", "isbn"), luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 70, ("phone", "tel", "call", "mobile", "fax"), ("score", "offset", "version"), dialled),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 90, ("iban", "account", "bank"), ("serial", "part"), None, account, False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", 40, ("ssn", "social", "security"), ("serial", "part", "order"), social, None, False),
)


def _score(kind: Kind, s: Column) -> Column:
    near = F.concat(F.lower(s["before"]), F.lit(" "), F.lower(s["after"]))
    says = lambda words: near.rlike(rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)").cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), kind.score + SUPPORT * (says(kind.good) - says(kind.bad))))


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS, least: int = 50) -> Column:
    """All kinds' spans in text (not null): array of struct(nr, start, end, kind, score), by kind, then start."""
    none = F.array().cast("array<struct<nr:int,start:int,end:int,kind:string,score:int>>")

    def of(nr: int, kind: Kind) -> Column:
        found = matches(text, kind.pattern, BEFORE, AFTER)
        if kind.confirm is not None:
            found = F.filter(found, kind.confirm)
        end = (lambda s: s["end"]) if kind.cut is None else (lambda s: s["start"] + F.length(kind.cut(s)))
        named = F.transform(found, lambda s: F.struct(F.lit(nr).alias("nr"), s["start"].alias("start"), end(s).alias("end"), F.lit(kind.name).alias("kind"), _score(kind, s).alias("score")))
        if kind.cut is not None:
            named = F.filter(named, lambda s: s["end"].isNotNull())
        if not kind.sure:
            named = F.filter(named, lambda s: s["score"] >= least)
        return F.when(text.rlike(kind.hint), named).otherwise(none)

    return F.concat(*(of(nr, kind) for nr, kind in enumerate(kinds)))


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least: int = 50) -> DataFrame:
    """docs with `pii`: array of struct(nr, start, end, kind, score), by kind in the given order, then start.

    Places are code points, end exclusive. Spans of one kind don't overlap; those of different kinds may, and are all
    given. A proposal that its validator refuses is dropped and not tried at another length. A null or empty text has
    no spans. Very long texts cost time in proportion to their length and to matches times their logarithm. Every row
    is judged alone: repeated rows and null ids stay; an empty table gives no rows. A column of docs named `pii` is
    replaced, all others pass through whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return computed_once(docs, pii=spans(text, kinds, least))


def redacted(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least: int = 50) -> DataFrame:
    """docs with each span of the text replaced by <KIND>; spans that overlap become one, named by the first of them.

    Null texts stay null; other columns pass through.
    """
    name = fresh("pii_spans", docs)
    rows = computed_once(docs, **{name: spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")), kinds, least)})
    text = F.col(text_col).cast("string")
    ordered = F.sort_array(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["nr"].alias("nr"), s["end"].alias("top"), s["kind"].alias("kind"))))
    reach = running(ordered, lambda s, e: F.struct(s["start"].alias("start"), s["nr"].alias("nr"), F.greatest(s["top"], e["top"]).alias("top"), s["kind"].alias("kind")), F.size(name))

    def cut(r: Column, chars: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(r, i - 1)["top"], F.lit(0))
        part = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        marks = F.transform(r, lambda s, i: F.when(s["start"] >= upto(i), F.concat(part(upto(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
        return F.concat(F.array_join(marks, ""), part(upto(F.size(r)), F.length(text)))

    whole = with_value(reach, lambda r: with_value(F.split(text, ""), lambda chars: cut(r, chars)))
    return rows.withColumn(text_col, F.when(F.size(name) > 0, whole).otherwise(text)).select(*docs.columns)


def joined(of: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
