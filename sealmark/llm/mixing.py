"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the source's words up to and with it,
divided by the source's target. Documents of all sources are then ordered by finish time and taken until the
total budget is met, so all sources run through their targets side by side. A source whose target is larger than
itself is queued again after its first pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.llm.columns import numbered, restored
from sealmark.llm.ordered import in_parts, with_sums
from sealmark.scratch import written

GAP = r"[\x20\x09-\x0D]+"
#: At most about so many rows of one source are summed in one window; a larger source gets more windows.
WINDOW_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(source, nr, source_size, target, digits): the budget, share * all sizes, dealt by weight; hash digits of a window.

    Sources in code point order, null last, take the weights in turn. No target is above passes * the source's
    size; what a source can't take is dealt again to the others by weight. With sources ordered by the level at
    which they fill up, those that do are a prefix, so one ordered pass finds them. One row per source is held.
    """
    digits = F.greatest(F.ceil(F.log(F.count("*") / WINDOW_ROWS) / F.log(F.lit(16.0))), F.lit(1)).cast("int")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), digits.alias("digits"))
    per = with_sums(per, "sources", F.col("source").asc_nulls_last(), place=F.lit(1).cast("long"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", "digits", (F.col("place") + 1).cast("int").alias("nr"), w.alias("weight"), (F.col("source_size") * F.lit(float(passes))).alias("cap"))
    per = per.withColumn("fills_at", F.col("cap") / F.col("weight"))
    per = with_sums(per, "levels", "fills_at", "nr", caps=F.col("cap"), weights=F.col("weight"), words=F.col("source_size"))
    level = (F.col("all_words") * F.lit(share) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    per = per.withColumn("level", level).withColumn("full", F.col("level") >= F.col("fills_at"))
    rest = per.agg(F.min(F.when(~F.col("full"), F.struct("fills_at", "nr", "level"))).alias("rest"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest.level") * F.col("weight"))
    return per.crossJoin(F.broadcast(rest)).select("source", "nr", "source_size", target.alias("target"), "digits")  # rest is one row


def _queued(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, seed: str) -> DataFrame:
    """docs with `mix`: struct(size, source_size, target, nr, h, id, cum); cum is the words of the source up to and with the row.

    Windows and the join to what comes before them go by the same two plain columns, so rows move once.
    """
    t = targets.select(F.col("source").alias("mix_source"), *(F.col(c).alias(f"mix_{c}") for c in ("nr", "source_size", "target", "digits")))
    rows = docs.join(t, docs[source_col].eqNullSafe(t["mix_source"])).drop("mix_source")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = rows.withColumn("mix_h", h).withColumn("mix_part", F.substring("mix_h", F.lit(1), F.col("mix_digits")))
    own = Window.partitionBy("mix_nr", "mix_part").orderBy("mix_h", F.col(id_col), F.col("mix_size"))
    inside = rows.withColumn("mix_in", F.sum("mix_size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # each window's words, then the words of the windows before it: a small table
    parts = rows.groupBy(F.col("mix_nr").alias("part_nr"), F.col("mix_part").alias("part_of")).agg(F.sum("mix_size").alias("part_words"))
    upto = Window.partitionBy("part_nr").orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part_nr", "part_of", F.coalesce(F.sum("part_words").over(upto), F.lit(0)).alias("part_before"))
    out = inside.join(parts, (F.col("mix_nr") == F.col("part_nr")) & (F.col("mix_part") == F.col("part_of")))
    mix = F.struct(
        F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_nr").alias("nr"), F.col("mix_h").alias("h"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), (F.col("mix_in") + F.col("part_before")).alias("cum"),
    )
    return out.select(*(c for c in docs.columns if c != "mix_size"), mix.alias("mix"))


def _turn(k: int) -> Column:
    """The place of the k-th pass over a document in the global order."""
    m = F.col("mix")
    finish = F.try_divide(m["cum"] + m["source_size"] * k, m["target"])
    return F.struct(finish.alias("finish"), m["nr"].alias("nr"), F.lit(k).alias("pass"), m["h"].alias("h"), m["id"].alias("id"), m["size"].alias("size"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: str = "mix",
) -> DataFrame:
    """docs with `mix` (size, source_size, target, taken, finish): words taken of each document, repeats counted.

    taken is a multiple of size, at most passes * size; the finish times of the copies taken are in `finish`.
    The order within a source is that of a hash of seed and id, so reruns agree. Null text: size 0, nothing
    taken. Null source: a source of its own. Null ids come first among equal hashes; rows that repeat an id
    follow one another by size. A column of docs named `mix` is replaced, others pass through whatever their names. Very long texts are
    counted whole; an empty table gives no rows. A source's sums are made per part of its hash range, as many parts
    as its rows ask for, so a large source is not one task's work.
    """
    docs, names = numbered(docs.drop("mix"))
    id_col, text_col, source_col = names[id_col], names[text_col], names[source_col]
    sized = docs.withColumn("mix_size", word_count(F.col(text_col)))
    narrow = written(sized.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("mix_size").alias("size")), "sizes")
    targets = written(source_targets(narrow, weights, share, passes), "targets")
    thin = _queued(narrow.withColumnRenamed("size", "mix_size"), targets, "id", "source", seed)
    turns = thin.where("mix.size > 0 and mix.target > 0").select(F.explode(F.array(*map(_turn, range(passes)))).alias("t"))
    # turns are range-sorted; only the part in which the budget ends is summed row by row
    turns = in_parts(turns.select("t"), "turns", "t")
    budget = targets.agg(F.sum("target").alias("budget"))
    parts = turns.groupBy("part").agg(F.sum("t.size").alias("words"), F.min("t").alias("first_turn"))
    parts = parts.withColumn("upto", F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))  # a row per part
    cut = parts.crossJoin(F.broadcast(budget)).where("upto > budget").agg(F.min(F.struct("part", "first_turn", (F.col("upto") - F.col("words")).alias("before"), "budget")).alias("cut"))
    last = turns.join(F.broadcast(cut), F.col("part") == F.col("cut.part"))
    last = last.withColumn("upto", F.col("cut.before") + F.sum("t.size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("upto <= cut.budget").agg(F.max("t").alias("last_turn"))
    ends = written(cut.select("cut.first_turn").crossJoin(last), "cut")  # one row; no first turn: all are taken
    rows = _queued(sized, targets, id_col, source_col, seed).crossJoin(F.broadcast(ends))

    def is_in(k: int) -> Column:
        t = _turn(k)
        ok = F.col("first_turn").isNull() | (t < F.col("first_turn")) | F.coalesce(t <= F.col("last_turn"), F.lit(False))
        return (F.col("mix.size") > 0) & (F.col("mix.target") > 0) & ok

    finish = F.filter(F.array(*(F.when(is_in(k), _turn(k)["finish"]) for k in range(passes))), lambda x: x.isNotNull())
    rows = rows.withColumn("mix_finish", finish)
    m = F.col("mix")
    done = F.struct(m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * F.size("mix_finish")).alias("taken"), F.col("mix_finish").alias("finish"))
    return restored(rows.withColumn("mix", done), names, "mix")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of docs, whatever their names, one row per copy taken, range-sorted by finish time."""
    bare, names = numbered(docs)
    rows = mix(bare, names[id_col], names[text_col], names[source_col], **options)
    copies = rows.withColumn("mix", F.explode("mix.finish"))
    return restored(copies.orderBy("mix"), names)
