"""The queries of this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, compression_quality, decontam, packing, pii, rules, setjoin, sharding, substring, tokens, twins

#: Place of the vocabulary of op10; None: the public tokenizers' own.
VOCABULARY: str | None = None

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), near=setjoin.Rule(words=5, percent=80))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return compression_quality.score(documents, compression_quality.train(documents, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_classes(table(spark, sf_dir, "documents"), setjoin.Rule(words=4, percent=85))


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_in_documents(table(spark, sf_dir, "documents")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.format_conversations(rows), in_order=True)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_in_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(table(spark, sf_dir, "documents"))


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = VOCABULARY
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_documents(table(spark, sf_dir, "documents"), path, end_id=2)


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_compression_quality": op2_compression_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_rendezvous_sharding": op5_rendezvous_sharding,
    "op6_personal_data": op6_personal_data,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_parquet": op10_token_parquet,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = dict(twins.BY_QUERY)
