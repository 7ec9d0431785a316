"""Removal of boilerplate lines by the number of distinct sites that carry them.

Built-in functions only. Sites per line are counted by HyperLogLog sketches, merged by aggregation; lines whose
estimate is near the threshold are counted exactly before anything is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.llm.columns import with_value
from sealmark.scratch import written

#: Boilerplate lines up to this many (20 bytes each) are broadcast; a longer list is joined by a shuffle.
BROADCAST_LINES = 500_000
LG_K = 8


def _key(line):
    """96 bits of a line without the blanks around it."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str | None = None, places: bool = False) -> DataFrame:
    """(doc, site if asked for, h, g) of every line with a word; with places also body, the text's hash, and its place there."""
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.split(F.col(text_col).cast("string"), "\n")
    if places:
        lines = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(has_word))
        keys = F.transform(lines, lambda s: F.struct(_key(s["x"]).alias("k"), s["i"].alias("place")))
        rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("body"), F.explode(keys).alias("p"))
        return rows.select("doc", "body", "p.k.h", "p.k.g", "p.place")
    site = [F.col(site_col).cast("string").alias("site")] if site_col else []
    keys = docs.select(F.col(id_col).alias("doc"), *site, F.explode(F.transform(F.filter(lines, lambda x: x.rlike(has_word)), _key)).alias("k"))
    return keys.select("doc", *(["site"] if site_col else []), "k.h", "k.g")


def boilerplate(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """(h, g, first_doc): the lines found on at least min_sites distinct sites, and the smallest id of their documents."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc").alias("first_doc"), F.count("*").alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select("h", "g", "first_doc", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("sites"))
    slack = max(1, round(min_sites * 4 * 0.83 / 2 ** (LG_K / 2)))
    spread = written(spread.where(F.col("sites") >= min_sites - slack), "spread")
    near = spread.where(F.col("sites") <= min_sites + slack)
    wanted = F.broadcast(near.select("h", "g")) if near.count() <= BROADCAST_LINES else near.select("h", "g")
    exact = lines.join(wanted, ["h", "g"], "left_semi").groupBy("h", "g", "site").agg(F.lit(1).alias("one"))
    exact = exact.where("site is not null").groupBy("h", "g").agg(F.count("*").alias("exact"))
    checked = near.join(exact, ["h", "g"]).where(F.col("exact") >= min_sites).select("h", "g", "first_doc")
    return spread.where(F.col("sites") > min_sites + slack).select("h", "g", "first_doc").union(checked)


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10,
) -> DataFrame:
    """docs with boilerplate lines taken out of the text, plus `n_removed` (long).

    A line (compared without the blanks around it) is boilerplate when at least min_sites distinct sites carry it.
    It stays in the document with the smallest id that has it, so every line of the corpus survives once, and goes
    from all others; blank lines stay. A null site is no site; null and empty texts stay; a null id is never the
    first, so such rows lose the line unless no document with an id has it. Rows that repeat an id lose or keep a
    line alike. Ties of ids can't matter; an empty table gives no rows. A very long text costs time in proportion to
    its lines. A column of docs named n_removed is replaced, others pass through.
    """
    common = written(boilerplate(docs, id_col, text_col, site_col, min_sites), "boilerplate")
    found = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    lost = _lines(docs, id_col, text_col, places=True).join(found, ["h", "g"]).where("first_doc is not null and (doc is null or doc <> first_doc)")
    lost = lost.groupBy("doc", "body").agg(F.sort_array(F.collect_set("place")).alias("places"))
    base = docs.drop("n_removed")
    text = base[text_col].cast("string")
    out = base.join(lost, base[id_col].eqNullSafe(lost["doc"]) & (F.xxhash64(text) == lost["body"]), "left")
    # the runs of lines between lost ones
    runs = with_value(
        F.struct(F.split(text, "\n").alias("lines"), F.concat(F.array(F.lit(-1)), lost["places"]).alias("at")),
        lambda v: F.flatten(F.transform(v["at"], lambda a, i: F.slice(v["lines"], a + 2, F.coalesce(F.get(v["at"], i + 1), F.size(v["lines"])) - a - 1))),
    )
    kept = F.when(lost["places"].isNotNull(), F.array_join(runs, "\n")).otherwise(text)
    return out.select(*(kept.alias(c) if c == text_col else base[c] for c in base.columns), F.coalesce(F.size(lost["places"]), F.lit(0)).cast("long").alias("n_removed"))
