"""Accuracy: error rates over thresholds, confusion reports, field and character accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sweep's thresholds are LOW, LOW + STEP .. in ten-thousandths; COUNT of them.
LOW, STEP, COUNT = 2000, 200, 38


def error_rates(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: far (impostors at or above threshold), frr (genuine below it); 0 without pairs."""
    of = lambda kind, hit: F.coalesce(F.avg(F.when(F.col("pair") == kind, hit.cast("double"))), F.lit(0.0))
    s = F.col("score")
    return pairs.agg(F.lit(threshold).alias("threshold"), of("impostor", s >= threshold).alias("far"), of("genuine", s < threshold).alias("frr"))


def threshold_sweep(pairs: DataFrame) -> DataFrame:
    """(threshold, far, frr) for all thresholds in one pass: scores become bins, bins are summed up from either end."""
    points = F.round(F.col("score") * 10000).cast("int")
    reached = F.greatest(F.lit(0), F.least(F.lit(COUNT), F.floor((points - LOW) / STEP).cast("int") + 1))  # thresholds <= score
    bins = pairs.groupBy(reached.alias("bin")).agg(F.count_if(F.col("pair") == "genuine").alias("g"), F.count_if(F.col("pair") == "impostor").alias("i"))
    every = pairs.sparkSession.range(COUNT + 1).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(bins), "bin", "left").na.fill(0)
    whole, below = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"g_all": F.sum("g").over(whole), "i_all": F.sum("i").over(whole), "g_low": F.coalesce(F.sum("g").over(below), F.lit(0)), "i_low": F.coalesce(F.sum("i").over(below), F.lit(0))})
    # bin k holds the scores that reach k thresholds: those under threshold number k are in bins 0 .. k - 1
    full = full.where("bin > 0")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return full.select(((F.lit(LOW) + (F.col("bin") - 1) * STEP) / 10000).alias("threshold"), share(F.col("i_all") - F.col("i_low"), F.col("i_all")).alias("far"), share(F.col("g_low"), F.col("g_all")).alias("frr"))


def equal_error(sweep: DataFrame) -> DataFrame:
    """The first threshold with the least distance of far and frr."""
    return sweep.agg(F.min_by(F.struct("threshold", "far", "frr"), F.struct(F.abs(F.col("far") - F.col("frr")), "threshold")).alias("e")).select("e.*")


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def confusion(rows: DataFrame, positive: str, *groups: str) -> DataFrame:
    """Counts and rates of predicted against expected; denominators are 1 at least. rows: expected, predicted."""
    e, p = F.col("expected") == positive, F.col("predicted") == positive
    out = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    part = lambda a, b: a / F.greatest(b, F.lit(1))
    tp, fp, fn, tn, n = map(F.col, ("tp", "fp", "fn", "tn", "n"))
    return out.withColumns({"accuracy": part(tp + tn, n), "false_reject": part(fp, fp + tn), "false_accept": part(fn, fn + tp), "precision_share": part(tp, tp + fp), "recall_share": part(tp, tp + fn)})


def folder_totals(rows: DataFrame) -> DataFrame:
    """Per folder and (folder null) in all: total, rejected, share correct; one pass by grouping sets."""
    out = rows.groupingSets([[F.col("folder")], []], "folder").agg(
        F.grouping("folder").cast("int").alias("is_total"), F.count("*").alias("total"), F.count_if(F.col("predicted") == "fraud").alias("rejected"), F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("correct_share")
    )
    return out


def spoof_prediction(risk: Column, passed: Column, has_face: Column, has_high: Column, threshold: float) -> Column:
    return F.when((risk >= threshold) | ~passed | ~has_face | has_high, "spoof").otherwise("live")


def field_accuracy(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, considered, correct, share): per field the rows with a truth, and those read rightly. A field is its
    truth's column name with a boolean column that says whether the reading equals it."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("considered"), (F.col(f).isNotNull() & F.coalesce(ok, F.lit(False))).alias("correct")) for f, ok in fields.items()))
    long = rows.select(F.explode(each).alias("f")).groupBy("f.field").agg(F.count_if("f.considered").alias("considered"), F.count_if("f.correct").alias("correct"))
    return long.withColumn("share", F.col("correct") / F.greatest("considered", F.lit(1)))


def char_accuracy(truth: Column, read: Column) -> Column:
    """1 - edit distance / the longer length; two empty texts 1, one empty 0."""
    a, b = F.coalesce(truth, F.lit("")), F.coalesce(read, F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a hash of seed and key; n <= 0: all. The same rows on every run."""
    return rows if n <= 0 else rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
