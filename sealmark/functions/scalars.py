"""Columns of verification records: masking, names, addresses, numbers, dates, sampling positions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealmark.functions.mrz import let

DOT = "•"
#: Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def mask_document_number(number: Column) -> Column:
    """First and last two characters with dots between; four characters or less are dots alone; null and '' stay."""
    bare = F.trim(number)
    n = F.length(bare)
    inner = F.concat(F.substring(bare, 1, 2), F.repeat(F.lit(DOT), n - 4), F.right(bare, F.lit(2)))
    return F.when((number.isNull()) | (number == ""), number).when(n <= 4, F.repeat(F.lit(DOT), n)).otherwise(inner)


def mask_contact(contact: Column) -> Column:
    """x***@domain for an address, *** and the last four characters for a longer number, else ***."""
    at = F.instr(contact, "@")
    domain = F.substring(contact, at + 1, F.length(contact))
    return (
        F.when(at > 0, F.concat(F.when(at > 1, F.substring(contact, 1, 1)).otherwise(""), F.lit("***@"), domain))
        .when(F.length(contact) > 4, F.concat(F.lit("***"), F.right(contact, F.lit(4)))).otherwise(F.lit("***"))
    )


def title_case(text: Column) -> Column:
    """Upper case for a letter after a non-letter, lower case for others."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def split_name(name: Column) -> Column:
    """struct(first_name, last_name): all parts but the last, and the last; `<` counts as a blank."""
    parts = F.filter(F.split(F.regexp_replace(name, "<", " "), r"\s+"), lambda p: p != "")
    n = F.size(parts)
    first = F.when(n == 1, F.element_at(parts, 1)).when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), " "))
    return F.struct(title_case(first).alias("first_name"), title_case(F.when(n > 1, F.element_at(parts, -1))).alias("last_name"))


def age_at(born: Column, as_of: Column) -> Column:
    """Whole years from born to as_of."""
    early = (F.month(as_of) < F.month(born)) | ((F.month(as_of) == F.month(born)) & (F.dayofmonth(as_of) < F.dayofmonth(born)))
    return F.year(as_of) - F.year(born) - early.cast("int")


def client_address(edge: Column, forwarded: Column, host: Column, trust_proxy: bool) -> Column:
    """The first address that a trusted proxy names, else the host, else 'unknown'."""
    head = lambda c: F.nullif(F.trim(F.split(c, ",")[0]), F.lit(""))
    plain = F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))
    return F.coalesce(head(edge), head(forwarded), plain) if trust_proxy else plain


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lowercase hex, by two nested digests over padded keys."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def blind_index(value: Column, primary_key: bytes) -> Column:
    """A keyed index of upper(trim(value)): equal values meet, others tell nothing. Null stays null."""
    return hmac_sha256(hashlib.sha256(primary_key + b"|blind-index").digest(), F.upper(F.trim(value)))


def clamp(x: Column) -> Column:
    """x held to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def number_check(value: Column, default: float = 0.0) -> Column:
    """A number out of a bag of strings: booleans count as 1 and 0, what doesn't parse as the default."""
    return F.when(F.lower(value) == "true", 1.0).when(F.lower(value) == "false", 0.0).otherwise(F.coalesce(value.try_cast("double"), F.lit(default)))


def attack_class(url: Column) -> Column:
    """The kind of presentation attack that a video's folder names."""
    folder = F.translate(F.lower(F.trim(F.url_decode(F.regexp_extract(url, r"/resolve/[^/]+/([^/?#]+)", 1)))), " ", "_")
    masks = F.lit(False)
    for word in ("cutout", "silicone", "latex", "textile", "mask"):
        masks = masks | folder.contains(word)
    return (
        F.when(folder.contains("replay"), "spoof_screen_replay").when(folder.contains("paper"), "spoof_print_paper")
        .when(masks, "spoof_mask_cutout").otherwise("spoof_unknown")
    )


def sample_fractions(n: Column) -> Column:
    """Evenly spaced places in a video, 0.2 to 0.8; one frame: the middle."""
    return F.when(n <= 1, F.array(F.lit(0.5))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1), lambda i: F.lit(0.2) + i * F.lit(0.6) / (F.greatest(n, F.lit(2)) - 1)))


def sample_frames(count: Column, n: Column) -> Column:
    """Frame numbers at sample_fractions; a video without a frame count gives frame 0."""
    return F.when(count <= 0, F.array(F.lit(0))).otherwise(F.transform(sample_fractions(n), lambda f: F.floor(count * f).cast("int")))


def even_frames(count: Column, n: Column) -> Column:
    """The frame numbers that cut a video into n + 1 equal parts, each once, rising; none without a frame count."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda r: F.floor(count * r / (n + 1)).cast("int"))
    return F.when((count > 0) & (n > 0), F.array_sort(F.array_distinct(at))).otherwise(F.array().cast("array<int>"))


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that the text holds, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, sorted(set(keywords)))), lambda k: F.contains(text, k)))


def romanized(name: Column) -> Column:
    """The Latin words of a name in two scripts, upper-case: what follows its last slash, without what stands in
    brackets; other characters but `<` part words. Null where no word is left."""
    side = F.substring_index(name, "/", -1)
    after = F.substring_index(side, ")", -1)  # no bracket closes in it
    before = F.left(side, F.length(side) - F.length(after))
    plain = F.concat(F.regexp_replace(before, r"\([^)]*+\)", " "), after)
    return F.nullif(F.trim(F.regexp_replace(F.upper(F.regexp_replace(plain, "[^A-Za-z<]", " ")), " +", " ")), F.lit(""))


def name_tokens(*names: Column) -> Column:
    """The sorted set of the names' upper-case words; null names have none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.upper(F.concat_ws(" ", *names)), r"(?U)\s+"), lambda t: t != "")))


def loose_date(text: Column) -> Column:
    """A printed date: a year of four digits, a month by name or else the first number up to 12, a day as the first
    number up to 31 that differs from the month, or that equals it. Null where one is missing or no such day exists."""
    named = lambda up: F.coalesce(*(F.when(up.contains(m.upper()), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    small = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda d: d.cast("int"))

    def dated(small: Column) -> Column:
        month = F.coalesce(let(F.upper(text), named), F.get(F.filter(small, lambda d: d.between(1, 12)), F.lit(0)))
        return let(F.struct(month.alias("month"), F.filter(small, lambda d: d.between(1, 31)).alias("days")), joined)

    def joined(p: Column) -> Column:
        year, day = F.regexp_extract(text, r"\b(\d{4})\b", 1), F.coalesce(F.get(F.filter(p["days"], lambda d: d != p["month"]), F.lit(0)), F.get(p["days"], F.lit(0)))
        return F.try_to_date(F.concat(let(year, lambda y: F.nullif(y, F.lit(""))), F.lit("-"), F.lpad(p["month"].cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")

    return let(small, dated)


def lighting_status(luminance: Column) -> Column:
    """dark, bright, flat or good, in that order, from an array of luminances between 0 and 1."""
    n = F.size(luminance)
    total = lambda f: F.aggregate(luminance, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = total(lambda x: x) / n
    spread = F.sqrt(F.greatest(total(lambda x: x * x) / n - mean * mean, F.lit(0.0)))
    over = total(lambda x: (x > 0.92).cast("double")) / n
    under = total(lambda x: (x < 0.08).cast("double")) / n
    return F.when((mean < 0.2) | (under > 0.42), "dark").when((mean > 0.82) | (over > 0.36), "bright").when(spread < 0.09, "flat").otherwise("good")
