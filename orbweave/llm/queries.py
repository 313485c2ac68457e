"""The numbered operators as queries on the tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import ann, chat, decontam, mixing, negatives, pii, quality, repair, repeats, simhash, tokenbin, tokencount, toxicity
from orbweave.storage import read_table, shared_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = quality.held_out(4, 2)
    weights = quality.fit(docs, labels, ~held)
    return quality.score(docs.select("doc_id", "text"), weights).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = quality.held_out(5, 0)
    return toxicity.score(docs, toxicity.fit(docs, labels, ~held)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "position")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    tokenbin.write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return tokenbin.read_token_files(spark, folder)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("uid")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read_table(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read_table(spark, sf_dir, "conversations"))[0]


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality, op2_token_counts, op3_nearest_neighbours, op4_toxicity, op5_mixing, op6_token_files, op7_personal_data, op8_decontamination, op9_chat, op10_simhash, op11_conversation_repair, op12_hard_negatives, op13_substring_dedup)
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.SQL, "op8_decontamination": decontam.SQL, "op9_chat": chat.SQL, "op11_conversation_repair": repair.SQL, "op12_hard_negatives": negatives.SQL, "op13_substring_dedup": repeats.SQL}
