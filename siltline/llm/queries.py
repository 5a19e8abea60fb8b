"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.session import cut, table


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes in fewer partitions than there are (one small file); large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm import warc

    found = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.pii import BASE, spans_of

    found = spans_of(spread(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "n_iban", "n_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document: its items (least id of equal ones, "null" without one), the best similarity and where it starts."""
    from siltline.llm.decontam import contaminated

    found = contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["similarity"], -m["start"], m["bits"])))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("matches").cast("long").alias("n_items"),
        F.concat_ws(",", F.transform("matches", lambda m: F.coalesce(m["item_id"].cast("string"), F.lit("null")))).alias("item_ids"),
        F.round(best["similarity"], 6).alias("similarity"),
        (-best["col2"]).alias("start"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltline.llm.bpe import digests

    found = digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.lm import BackoffScorer, held_out

    found = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread(found)
    # read more than once: rows that were dealt out anew must keep their order
    scored = BackoffScorer().score(docs if docs is found else cut(docs), ~held_out("doc_id", 7, 2))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.lm import held_out
    from siltline.llm.toxicity import fit, scored

    docs, unseen = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = fit(docs, table(spark, sf_dir, "labels"), ~unseen)
    found = scored(spread(docs.select("doc_id", "text")), model)
    return found.select("doc_id", unseen.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.simhash import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.substring import SubstringDedup

    found = SubstringDedup().run_on(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.lm import held_out
    from siltline.llm.quality import fit, graded

    docs, unseen = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    found = graded(spread(docs), fit(docs, table(spark, sf_dir, "labels"), ~unseen))
    return found.withColumnRenamed("id", "doc_id").withColumn("held_out", unseen)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.rules import judged

    return judged(spread(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
