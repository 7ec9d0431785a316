"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions.columns import fresh


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, … and the new name of each: no column that is added then meets one of them."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], *more: Column | str) -> DataFrame:
    """The columns of docs under their own names, and more of df's."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()), *more)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns; filters above see values, not expressions.

    A filter on a plain computed column is moved below the projection and takes a copy of the expression along for
    every mention; a generated row of one is not looked through.
    """
    base = [c for c in df.columns if c not in columns]
    held = fresh("computed_row", df)
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(held)
    return df.select(*base, row).select(*base, *(F.col(f"{held}.{n}").alias(n) for n in columns))


def with_value(value: Column, use) -> Column:
    """use(value), the value being computed once per row although lambdas inside `use` mention it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, step, most: Column) -> Column:
    """Prefix results of an associative step over an array, by doubling steps: n log n, where a fold that appends is n * n.

    step(item, earlier) gives the item with what came before it; `most` is a number of items that the array can't exceed.
    """
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(most + 2.0)).cast("int"))

    def doubled(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda s, i: step(s, F.get(acc, i - F.pow(F.lit(2.0), k).cast("int"))))

    return F.aggregate(doublings, items, doubled)


def matches(text: Column, pattern: str, before: int, after: int) -> Column:
    """Leftmost, not overlapping matches: array of struct(start, end, value, before, after), places in code points.

    before and after are the text next to the match, up to so many characters, and no further than the next match.
    """

    def found(gaps: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        items = F.transform(whole, lambda m, i: F.struct(
            (F.length(F.get(gaps, i)) + F.length(m)).alias("end"), m.alias("value"),
            F.right(F.get(gaps, i), F.lit(before)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(after)).alias("after"),
        ))
        rest = ("value", "before", "after")
        placed = running(items, lambda s, e: F.struct((s["end"] + F.coalesce(e["end"], F.lit(0))).alias("end"), *(s[c].alias(c) for c in rest)), F.length(text))
        return F.transform(placed, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), *(s[c].alias(c) for c in rest)))

    return with_value(F.split(text, pattern, -1), found)
