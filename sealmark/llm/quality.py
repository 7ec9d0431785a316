"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, policies are masks over the bits.

Built-in functions only. A word is `[^\\x20\\x09-\\x0D]+`, a line ends at \\n. Null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.llm.columns import computed_once

GAP = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A name, its bit, and the SQL condition over the measures under which a document fails it."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a stored ledger stays readable under later policies.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
)


def mask_of(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


#: A policy is a version and the rules that reject.
POLICIES = {
    1: mask_of("few_words", "repeated_windows"),
    2: mask_of("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one struct column `measure`; columns of docs keep their names, whatever these are."""
    out = docs.withColumn("measure", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = F.filter(F.split("measure", GAP), lambda w: w != "")
    lines = F.filter(F.split("measure", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("measure", F.struct(words.alias("w"), lines.alias("lines"), F.regexp_count("measure", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols")))
    w = F.col("measure.w")
    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.when(F.size(w) >= 3, F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("measure", F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "measure.n_symbols",
        F.size("measure.lines").cast("long").alias("n_lines"), (F.size("measure.lines") - F.size(F.array_distinct("measure.lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    ))
    # only texts with some repeated window are sorted to find where those windows stand
    h = F.col("measure.windows")
    ranked = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = out.withColumn("measure", F.struct(*(f"measure.{m}" for m in MEASURES[:-1]), ranked.alias("ranked")))
    r = F.col("measure.ranked")
    same = lambda s, other: F.coalesce(other["x"] == s["x"], F.lit(False))
    twice = F.filter(r, lambda s, i: same(s, F.get(r, i - 1)) | same(s, F.get(r, i + 1)))
    places = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    repeat = F.when(r.isNull(), F.lit(0)).otherwise(F.size(places)).cast("long")
    return out.withColumn("measure", F.struct(*(f"measure.{m}" for m in MEASURES[:-1]), repeat.alias("n_repeat_words")))


def failure_bits(measure: str = "measure") -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        condition = rule.fails
        for m in sorted(MEASURES, key=len, reverse=True):
            condition = condition.replace(m, f"{{{MEASURES.index(m)}}}")
        condition = condition.format(*(f"{measure}.{m}" for m in MEASURES))
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `measure` (struct of MEASURES) and `failed` (long, bit k set where rule k fails).

    Null, empty or blank text: no words, fails few_words. Each row is judged alone: repeated rows and null ids stay,
    and no order decides, so there are no ties. Very long texts are measured whole, in time near linear in their
    words. An empty table gives no rows. A column of docs named `measure` or `failed` is replaced; all others pass
    through whatever their names.
    """
    return computed_once(measured(docs, text_col), measure=F.col("measure"), failed=failure_bits())


def verdict(version: int, failed: str | Column = "failed") -> Column:
    """True where the document passes the policy."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(book: DataFrame, version: int) -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_only (rejected by it alone, kept without it), n_rejected (by the policy).

    Documents are first counted per pattern of bits, so at most 2^rules rows are shuffled.
    """
    mask = POLICIES[version]
    patterns = book.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if mask >> r.bit & 1))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("r.bit")).alias("n_only"),
        count(F.col("bits") != 0).alias("n_rejected"),
    )
