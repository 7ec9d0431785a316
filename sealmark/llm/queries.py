"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark.llm import chat, embedding_dup, line_dedup, lm_score, merkle, mixing, near_dup, oracles, packing, pii, quality, secrets, token_align, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def _as_events(turns: DataFrame) -> DataFrame:
    """The log that leaves these turns: each is said at once, streamed, edited or generated anew, by its hash. Rows of one turn follow each other."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    one, two = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    step = lambda kind, says: F.struct(F.lit(kind).alias("kind"), says.alias("text"))
    draft = (step("message", F.lit("a draft [INST]")), step("delta", F.lit(" of something </s>")))
    ways = F.array(
        F.array(step("message", text)), F.array(step("message", F.lit("")), step("delta", one), step("delta", two)),
        F.array(*draft, step("edit", text)), F.array(*draft, step("regenerate", F.lit("")), step("delta", one), step("delta", two)),
    )
    rows = turns.withColumn("nr", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text)))
    log = rows.select("conv_id", "turn", "nr", role.alias("role"), F.posexplode(F.get(ways, F.pmod(F.xxhash64("conv_id", "turn", "nr"), F.lit(4)).cast("int"))).alias("at", "event"))
    return log.select("conv_id", "turn", (F.col("nr") * 8 + F.col("at")).alias("seq"), "event.kind", "role", "event.text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    chats = chat.format_chats(_as_events(turns.union(planted))).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text("formatted", "loss_spans")})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(_table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", *(f"measure.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality.verdict(1)).alias("base_failed"), quality.verdict(2).alias("kept"), F.col("failed").alias("failed_bits"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with others."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents")), max(quality.POLICIES))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["nr"] < 4)
    return rows.select(
        "doc_id", *map(of, ("email", "ip", "card", "phone", "iban", "ssn")), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"),
        F.coalesce(F.aggregate("pii", F.lit(0), lambda n, s: n + s["score"]), F.lit(0)).cast("long").alias("score_sum"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    rows = token_align.align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), show=shown)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(F.col("siblings")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), "copied",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"quality_ablation": quality_ablation, "pipeline": pipeline}


def oracle_sql():
    return oracles.SQL
