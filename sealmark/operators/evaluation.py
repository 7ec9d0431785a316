"""Evaluation of passport reading: from what an engine read and a truth file to rates, in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions.scalars import name_tokens
from sealmark.operators import documents, metrics, scoring, zones
from sealmark.scratch import written


def adapter_findings(measured: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, family, model_id, score, confidence, status) of the built-in models, from rows that adapter_scores() takes."""
    rows = scoring.adapter_scores(measured)
    one = lambda family, name, score, sure: F.struct(F.lit(family).alias("family"), F.lit(name).alias("model_id"), F.col(score).alias("score"), F.col(sure).alias("confidence"), F.lit("available").alias("status"))
    each = F.array(one("document_liveness", "heuristic_recapture_v1", "liveness_model", "liveness_confidence"), one("tamper", "heuristic_tamper_v1", "tamper_model", "tamper_confidence"))
    return rows.select(F.col(key).alias("doc_id"), F.explode(each).alias("f")).select("doc_id", "f.*")


def passport_readings(samples: DataFrame, as_of: Column) -> DataFrame:
    """One row per sample: doc_id, folder, zone, status, fraud_risk_score, signals, and truth (a struct of TRUTH_FIELDS).

    samples: doc_id, folder, text (read by an engine), truth (a truth file's text), and the measures of the image that
    the document scores and adapter_scores() take. Each text is read once; what reports need is written, so that any
    number of them share it.
    """
    measured = scoring.forensic_risk(scoring.document_likeness(scoring.document_quality(samples)))
    models = scoring.document_ensemble(adapter_findings(measured)).select(F.col("doc_id").alias("of_doc"), "fraud", F.col("recapture").alias("model_recapture"), F.col("tamper").alias("model_tamper"), F.col("confidence").alias("model_confidence"), "model_signals")
    found = ("quality_signals", "likeness_signals", "forensic_signals", "quality_score", "likeness_score", "recapture_risk", "tamper_risk")
    read = zones.read_passports(measured.select("doc_id", "folder", "text", "truth", *found), as_of).withColumnRenamed("signals", "zone_signals")
    told = documents.truth_fields(read, as_of, "truth").select("doc_id", "folder", *found, "zone", "zone_signals", F.struct(*documents.TRUTH_FIELDS).alias("told"))
    # sizes are guessed from a packed file, so neither side is left to a broadcast
    rows = told.join(models.hint("merge"), F.col("doc_id") == F.col("of_doc"))
    rows = rows.withColumns({"signals": F.concat("quality_signals", "likeness_signals", "zone_signals", "forensic_signals", "model_signals"), "confidence": F.col("model_confidence")})
    out = scoring.document_risk(rows).select("doc_id", "folder", "zone", "status", "fraud_risk_score", "signals", F.col("told").alias("truth"))
    return written(out, "readings")


def is_passport() -> Column:
    """The truth has both zone lines."""
    return F.col("truth.mrz_line1").isNotNull() & F.col("truth.mrz_line2").isNotNull()


def genuine_rates(readings: DataFrame) -> DataFrame:
    """One row for a set of genuine passports: total, and the shares passed, with a zone read and with a valid one."""
    share = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 4)
    return readings.agg(F.count("*").alias("total"), share(F.col("status") == "passed").alias("passed_rate"), share(F.col("zone").isNotNull()).alias("read_rate"), share(F.col("zone.valid")).alias("valid_rate"))


def field_report(readings: DataFrame) -> DataFrame:
    """(field, considered, correct, share) of passports: a field is considered where the truth has it; one that wasn't read is wrong.

    Names are compared as sets of words; numbers without filler.
    """
    t, z = (lambda c: F.col(f"truth.{c}")), (lambda c: F.col(f"zone.{c}"))
    told = name_tokens(t("surname"), t("given_names"))
    rows = readings.where(is_passport()).select("*", F.when(F.size(told) > 0, told).alias("name"), *(t(c).alias(c) for c in ("passport_number", "nationality", "date_of_birth", "sex", "expiry_date")))
    return metrics.field_accuracy(rows, {
        "passport_number": t("passport_number") == F.upper(F.replace(z("passport_number"), F.lit("<"), F.lit(""))), "name": told == name_tokens(z("given_names"), z("surname")),
        "nationality": t("nationality") == F.upper(z("nationality")), "date_of_birth": t("date_of_birth") == z("date_of_birth"),
        "sex": t("sex") == F.when(z("sex").isin("M", "F"), z("sex")), "expiry_date": t("expiry_date") == z("expiry_date"),
    })


def line_report(readings: DataFrame) -> DataFrame:
    """(line, considered, exact, accuracy) of passports: zone lines read exactly, and their mean share of right characters."""
    plain = lambda x: F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9<]", "")
    read = F.split(F.coalesce("zone.mrz_text", F.lit("")), "\n")
    each = F.array(*(F.struct(F.lit(k + 1).alias("line"), plain(F.col(f"truth.mrz_line{k + 1}")).alias("truth"), plain(F.get(read, F.lit(k))).alias("read")) for k in range(2)))
    lines = readings.where(is_passport()).select(F.explode(each).alias("l")).select("l.*")
    return lines.groupBy("line").agg(F.count("*").alias("considered"), F.count_if(F.col("truth") == F.col("read")).alias("exact"), F.avg(metrics.char_accuracy(F.col("truth"), F.col("read"))).alias("accuracy"))


def negative_control(readings: DataFrame) -> DataFrame:
    """One row for samples that aren't passports: how many, and the share in which no zone was found."""
    return readings.where(~is_passport()).agg(F.count("*").alias("checked"), F.round(F.coalesce(F.avg(F.col("zone").isNull().cast("double")), F.lit(0.0)), 6).alias("clean_share"))


def report(readings: DataFrame, genuine: Column) -> DataFrame:
    """All reports in one table: (report, item, value), of readings written once."""

    def long(name: str, df: DataFrame, item: Column, values: tuple[str, ...]) -> DataFrame:
        return df.select(F.lit(name).alias("report"), F.explode(F.array(*(F.struct(F.concat_ws("/", item, F.lit(v)).alias("item"), F.col(v).cast("double").alias("value")) for v in values))).alias("r")).select("report", "r.*")

    parts = [
        long("genuine", genuine_rates(readings.where(genuine)), F.lit("all"), ("total", "passed_rate", "read_rate", "valid_rate")),
        long("fields", field_report(readings), F.col("field"), ("considered", "correct", "share")),
        long("lines", line_report(readings), F.col("line").cast("string"), ("considered", "exact", "accuracy")),
        long("control", negative_control(readings), F.lit("all"), ("checked", "clean_share")),
        long("signals", scoring.top_signals(readings.where(genuine), "signals", 10), F.col("code"), ("n",)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
