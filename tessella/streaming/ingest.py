"""Streaming ingestion: landed files merged batch by batch, each batch idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25, index
from ..schema import RAW_ISSUE
from ..sources.store import IndexStore


def issue_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Landed JSON lines, compressed or not, as a stream; a file is a page."""
    return spark.readStream.schema(RAW_ISSUE).option("maxFilesPerTrigger", files_per_batch).json(path).where("number IS NOT NULL")


def merge_batch(store: IndexStore, repo: str):
    """A batch's issues into the index: the newest row of each number, unless a newer one is stored. Replaying a batch changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        store.create()
        old = store.table("issues")
        newest = index.latest(batch, ["number"], "updated_at").withColumn("repo", F.lit(repo))
        stored = old.where(F.col("repo") == repo).select("number", F.col("updated_at").alias("_stored"))
        fresh = newest.join(stored, "number", "left").where(F.col("_stored").isNull() | (F.col("updated_at") >= F.col("_stored"))).drop("_stored")
        merged = index.upsert(old, fresh).persist()
        try:
            changed = merged.join(fresh.select("repo", "number"), ["repo", "number"], "left_semi")
            stored = bm25.TextIndex(store.table("postings"), store.table("lengths"), store.table("text_stats"))
            store.publish({"issues": merged, **bm25.stored(bm25.updated(stored, changed))})
        finally:
            merged.unpersist()

    return run


def ingest(spark: SparkSession, store: IndexStore, repo: str, path: str, checkpoint: str) -> StreamingQuery:
    """Take in all files that have landed since the last run, then stop."""
    return issue_stream(spark, path).writeStream.foreachBatch(merge_batch(store, repo)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
