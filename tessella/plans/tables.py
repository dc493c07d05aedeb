"""The test tables in the engine's roles: documents as issues, conversations as comments, events as the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from ..session import written

NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id is id and number, source the repository, the first line the title."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("repo"),
        F.col("doc_id").alias("number"),
        F.when(F.col("doc_id") % 5 == 0, "pr").otherwise("issue").alias("kind"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("lang") == "en", "open").otherwise("closed").alias("state"),
        F.array("lang", "source").alias("labels"),
        F.concat(F.lit("user"), F.col("doc_id") % 7).alias("author"),
        (F.col("doc_id") % 3).alias("comments_count"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("updated_at"),
        F.lit(None).cast("string").alias("embedded_hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("issue_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("issue_id"), F.col("turn").alias("idx"), F.when(F.col("role") == "system", "helper[bot]").otherwise(F.col("role")).alias("author"), F.col("text").alias("body"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type is the tool (click: a search), props the query, a value over 150 a follow-up."""
    tool = F.when(F.col("event_type") == "click", "search_issues").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", tool.alias("tool"), F.col("props").alias("query"), F.lit(None).cast("string").alias("filters"),
        F.array(F.concat(F.lit("r#"), F.col("user_id"))).alias("results"), F.when(F.col("value") > 150, F.concat(F.lit("r#"), F.col("user_id"))).alias("follow_up"),
    )


_indexes: dict[tuple, bm25.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> bm25.TextIndex:
    """The stored text index of the documents, as a sync keeps it; built once in a session for each state of the table's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(path)
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    key = (spark.sparkContext.applicationId, state)
    if key not in _indexes:
        index = bm25.build(issues(spark, sf_dir))
        lengths = written(index.lengths, "lengths")
        made = bm25.stored(bm25.TextIndex(index.postings, lengths, bm25.stats_of(lengths)))
        _indexes[key] = bm25.TextIndex(written(made["postings"], "postings"), lengths, written(made["text_stats"], "text-stats"))
    return _indexes[key]
