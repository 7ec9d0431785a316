"""Fraud signals: array<struct<code, severity, score>> columns, their folds and ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealmark.functions.scalars import clamp

TYPE = "array<struct<code:string,severity:string,score:double>>"
#: Weight of a signal's score in the document risk.
WEIGHTS = {"low": 0.16, "medium": 0.34, "high": 0.62}
#: Signals that reject a document alone.
HARD_FAIL = (
    "NON_IMAGE_UPLOAD", "UNSUPPORTED_FILE_TYPE", "LOW_RESOLUTION", "BLUR_DETECTED", "NON_DOCUMENT_UPLOAD", "MRZ_NOT_READ", "MRZ_INVALID",
    "MRZ_CHECK_DIGIT_MISMATCH", "PASSPORT_EXPIRED", "LAO_ID_NOT_RECOGNIZED", "LAO_ID_NUMBER_NOT_READ", "LAO_ID_EXPIRED", "TAMPER_RISK_HIGH",
    "RECAPTURE_RISK_HIGH", "DOCUMENT_TAMPER_MODEL_RISK_HIGH", "DOCUMENT_RECAPTURE_MODEL_RISK_HIGH", "DOCUMENT_PRINT_COPY_RISK_HIGH",
    "DOCUMENT_FRAUD_MODEL_RISK_HIGH", "DOCUMENT_FACE_SUBSTITUTION_RISK_HIGH",
)


def signal(code: str, severity: str, score) -> Column:
    score = score if isinstance(score, Column) else F.lit(float(score))
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.round(clamp(score), 2).alias("score"))


def ladder(*rungs) -> Column:
    """Signals in order. A rung is (condition, code, severity, score); a list of rungs gives its first that holds."""
    out = []
    for rung in rungs:
        steps = rung if isinstance(rung, list) else [rung]
        case = F.when(steps[0][0], signal(*steps[0][1:]))
        for step in steps[1:]:
            case = case.when(step[0], signal(*step[1:]))
        out.append(case)
    return F.array_compact(F.array(*out)).cast(TYPE)


def codes(signals: Column) -> Column:
    """Codes joined by |, in order."""
    return F.array_join(F.transform(signals, lambda s: s["code"]), "|")


def has_severity(signals: Column, severity: str) -> Column:
    return F.exists(signals, lambda s: s["severity"] == severity)


def of_severity(signals: Column, severity: str) -> Column:
    return F.filter(signals, lambda s: s["severity"] == severity)


def total(signals: Column, worth) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + worth(s))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def dedupe(signals: Column) -> Column:
    """One signal per code, at its first place: a later one replaces it when its severity ranks higher or its score is larger."""
    def step(acc, s):
        at = F.array_position(F.transform(acc, lambda a: a["code"]), s["code"])
        old = F.get(acc, (at - 1).cast("int"))
        better = (severity_rank(s["severity"]) > severity_rank(old["severity"])) | (s["score"] > old["score"])
        replaced = F.transform(acc, lambda a: F.when((a["code"] == s["code"]) & better, s).otherwise(a))
        return F.when(at > 0, replaced).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(signals, F.array().cast(TYPE), step)
