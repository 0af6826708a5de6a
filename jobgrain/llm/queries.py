"""The registered queries of the training-data operators: thin digests over ``jobgrain.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.llm import (
    brown_lm,
    chat_format,
    decontamination,
    embedding_dedup,
    license_scan,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    sharding,
    simhash_dedup,
    spelling_variants,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.last_reply_pairs(_table(spark, sf_dir, "conversations"))
    examples = chat_format.assemble(chat_format.preference_messages(*pairs))
    return examples.withColumns({c: chat_format.written_spans(F.col(c)) for c in ("chosen_trained", "rejected_trained")})


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, power=0.5)
    return pieces.drop("ids")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True, full=False).drop("runs", "collapsed")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"), garble=spelling_variants.GARBLE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_simhash": op2_simhash,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_sharding": op4_sharding,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_brown_lm": op7_brown_lm,
        "op8_license_scan": op8_license_scan,
        "op9_chat_format": op9_chat_format,
        "op10_packing": op10_packing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_pii": op12_pii,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": license_scan.oracle(), "op9_chat_format": chat_format.ORACLE, "op12_pii": pii.oracle()}
