"""The corpus pipeline: language identification, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.

Edge cases: an empty table passes through every stage; rows with a null text are rejected by language
identification; further columns, of any name, are carried unchanged through all stages but the last; rows of one doc_id, or of none, are
judged each by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import decontaminate, language_id, packing, secret_scan, simhash_wide
from corvane.llm.common import Scratch, fresh, quoted, row_key, table
from corvane.llm.queries import tokenizer_path

#: a prediction's least score; that of clear prose is above 0.9
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or whose language is not clear, go."""
    told, sure = fresh(docs, "_told", "_sure")
    rows = language_id.identify(docs, language_id.train(docs), keep=tuple(docs.columns), names=(told, sure))
    return rows.where((F.col(told) != "und") & (F.col(sure) >= LEAST_SCORE)).select(*[quoted(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links of five-word shingles at a similarity of 0.8 connect."""
    return simhash_wide.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows are told by id and text, so that a clean one stays beside a leaking one of its id."""
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*[quoted(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the training sequences."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: no SQL has these stages; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of `sf_dir`, one after another."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
