"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. As a stage's result has been written when the
next one starts, each stage first deletes the tables that those before it left in the shared folder.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontam, mixing, quality, simhash, tokenbin
from orbweave.llm.queries import END_ID, TOKENIZER
from orbweave.storage import materialise, read_table, recording, release, shared_path

_left: dict[str, list[str]] = {}  # by application: intermediate tables of the stage before


def tidy(stage):
    """``stage``, after the tables that the stage before left are deleted."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left.pop(spark.sparkContext.applicationId, []))
        with recording() as made:
            kept = stage(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = made
        return kept

    return tidied


@tidy
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels, does not reject."""
    weights = quality.fit(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, weights).where("predicted = 1").select(*docs.columns)


@tidy
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near-duplicates."""
    return simhash.keep_one(docs)


@tidy
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item occur."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (once, twice or not at all), in training order."""
    return mixing.training_order(docs)


def in_place(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row: ``__file`` and ``__row`` of the Parquet files that it is read from, else its number."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        return docs.select("*", F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))


@tidy
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, in training order; doc_id, start, n_tokens and ids_crc32 of each document as read back from them."""
    folder = shared_path(spark, "token-files")
    tokenbin.write_token_files(in_place(docs), folder, public_tokenizers.path(TOKENIZER), END_ID, by=("__file", "__row"))
    return tokenbin.read_token_files(spark, folder)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
