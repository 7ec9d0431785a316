"""A training corpus from `documents`: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm import line_dedup, mixing, near_dup, packing, quality
from sealmark.llm.columns import computed_once, numbered, restored
from sealmark.llm.queries import tokenizer_path
from sealmark.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps.

    Null, empty and blank texts have too few words and go. Very long texts are measured whole. Null ids, null sources
    and repeated rows are judged like others, each row alone. An empty table stays empty.
    """
    bare, names = numbered(docs)
    return restored(quality.ledger(bare, names["text"]).where(quality.verdict(max(quality.POLICIES))), names)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines removed; documents that hold no other line are gone, each of their lines stays elsewhere.

    n_chars is counted anew where lines went. Null texts stay as they are; a null source is no site; a document with
    a null id is never a line's first, so it loses the line to one with an id. Rows that repeat an id keep or lose a
    line alike. Very long texts are cut line by line. An empty table stays empty.
    """
    bare, names = numbered(docs)
    text, size = names["text"], names["n_chars"]
    rows = line_dedup.remove_boilerplate(bare, names["doc_id"], text, names["source"])
    rows = computed_once(rows, **{text: F.col(text), "n_removed": F.col("n_removed")})
    rows = rows.where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType)
    return restored(rows.withColumn(size, n_chars), names)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id; links from a similarity of 0.8 on.

    Rows that repeat an id are one document and stay or go together. Rows with a null id are in no component and
    stay, as do null and empty texts. Very long texts are compared whole. An empty table stays empty.
    """
    gone = near_dup.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, in mix order; one row per copy.

    Documents without words are never drawn. A null source is a source of its own, the last. Null ids come first among
    equal hashes; rows that repeat an id are drawn each. Very long texts count whole, and aren't cut at the budget's
    end: a copy that would exceed it is left out. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents, placed in sequences.

    Every row is packed, copies, repeated rows and null ids included; a null text is its end alone. Texts of more ids
    than a sequence holds are cut into pieces. Equal pieces are placed in a fixed order. An empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenised packing has no SQL form; tests hold run() against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
