"""The corpus pipeline: five stages over documents, each written and read again by the next.

Every stage but the last returns the columns of ``documents``. Stages act on all that the one
before has kept, and their decisions take effect: rejected documents, boilerplate lines, near
copies and personal data don't reach the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bayes_minhash, bin_slack, line_spread, surrogates, toxicity
from tessella.llm._common import documents, written

#: From this Jaccard similarity of word shingles on, in per cent, documents are near copies.
NEAR_PERCENT = 80


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """With n_chars counted anew, where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the lexicon is learnt from the labels that aren't held out."""
    terms, fuzzy = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, terms, fuzzy)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; one that consisted of such lines alone goes."""
    done = line_spread.dedup_lines(docs)
    return _as_documents(done.where((F.col("n_removed") == 0) | (F.trim("text") != "")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Rows without doc_id stay."""
    gone = bayes_minhash.near_duplicates(docs, NEAR_PERCENT).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"))
    return docs.join(written(gone, "copies"), F.col("doc_id") == F.col("_gone"), "left_anti")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _as_documents(surrogates.replace(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return bin_slack.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learning, sketches, signatures and tokenizers are beyond SQL; a brute-force version in the tests holds the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
