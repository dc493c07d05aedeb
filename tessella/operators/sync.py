"""Incremental sync of a repository into the index."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint, text
from ..sources import embedder as E
from ..sources import github, raw
from ..sources.store import IndexStore
from . import bm25, index, relations


@dataclass(frozen=True)
class SyncParams:
    batch: int = 64
    title_repeats: int = text.TITLE_REPEATS
    body_max: int = text.BODY_MAX


@dataclass(frozen=True)
class SyncReport:
    fetched: int
    embedded: int
    skipped: int
    cursor: str | None


def land(spark: SparkSession, store: raw.RawStore, repo: str, issue_pages: Iterable[str], comment_pages: Iterable[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Stage pages in the raw layer one by one, so that a failure keeps what came before, and merge them once; returns the issues and comments that came."""
    got: list[DataFrame | None] = [None, None]
    for page in issue_pages:
        rows = raw.to_raw(github.parse_issues(spark.createDataFrame([(repo, page)], "repo string, json string")))
        store.stage(repo, "issues", rows)
        got[0] = rows if got[0] is None else got[0].unionByName(rows)
    for page in comment_pages:
        rows = github.parse_comments(spark.createDataFrame([(page,)], "json string"))
        store.stage(repo, "comments", rows)
        got[1] = rows if got[1] is None else got[1].unionByName(rows)
    store.merge(repo, "issues")
    store.merge(repo, "comments")
    return got[0], got[1]


def sync_repo(spark: SparkSession, store: IndexStore, landing: raw.RawStore, source, embedder: E.Embedder, repo: str, params: SyncParams = SyncParams(), now: datetime | None = None, rebuild: bool = False) -> SyncReport:
    """Fetch what changed since the cursor, embed what has another text, and publish everything at once.

    ``source`` has issue_pages(repo, since) and comment_pages(repo, since). Issues whose text hash
    is known and that have a vector keep it; their other columns and comments are still updated.
    With ``rebuild``, all landed issues count as touched.
    """
    store.create()
    fp = fingerprint.ensure(store.manifest("embedding_fp"), fingerprint.full(embedder.fingerprint(), params.title_repeats, params.body_max))
    state = store.table("sync_state").where(F.col("repo") == repo).first()
    since = state.cursor_updated_at if state else None
    issues, comments = land(spark, landing, repo, source.issue_pages(repo, since), source.comment_pages(repo, since))
    whole = landing.load(repo)
    none_i, none_c = spark.createDataFrame([], raw.RAW_ISSUE), spark.createDataFrame([], raw.RAW_COMMENT)
    touched = whole if rebuild else whole.join(index.touched(none_i if issues is None else issues, none_c if comments is None else comments), "number", "left_semi")
    assembled = text.build_text_with_comments(F.col("title"), F.col("body"), text.without_bots(F.col("comments")), params.title_repeats, params.body_max)
    touched = touched.withColumn("text", assembled).withColumn("hash", F.sha1(F.col("text").cast("binary"))).persist()
    try:
        old, vecs = store.table("issues"), store.table("issues_vec")
        actions = index.decide(touched.select("repo", "number", "hash"), old, vecs)
        rows = touched.join(actions.select("repo", "number", "action"), ["repo", "number"])
        columns = ["repo", "number", "kind", "title", "body", "state", "labels", "author", "comments_count", "created_at", "updated_at"]
        merged = index.upsert(old, rows.select(*columns, F.col("hash").alias("embedded_hash"))).persist()
        ids = merged.select("id", "repo", "number")
        pending = rows.where("action = 'embed'").join(ids, ["repo", "number"])
        new_vecs = E.embed(pending, embedder, "id", params.batch).select(F.col("id").alias("issue_id"), "embedding").persist()
        talk = rows.join(ids, ["repo", "number"]).select(F.col("id").alias("issue_id"), F.posexplode("comments").alias("idx", "c")).select("issue_id", F.col("idx").cast("long").alias("idx"), "c.author", "c.body")
        gone = rows.join(ids, ["repo", "number"]).select(F.col("id").alias("issue_id"))
        text_index = bm25.updated(bm25.TextIndex(store.table("postings"), store.table("lengths"), store.table("text_stats")), merged.join(gone.withColumnRenamed("issue_id", "id"), "id", "left_semi"))
        edges = relations.replace(store.table("relations"), rows, relations.extract(rows.select("repo", "number", "title", "body")))
        cursor = None if issues is None else issues.agg(F.max("updated_at")).first()[0]
        cursor = cursor or since
        at = now or datetime.now(timezone.utc).replace(tzinfo=None)
        states = store.table("sync_state").where(F.col("repo") != repo).unionByName(spark.createDataFrame([(repo, cursor, at)], "repo string, cursor_updated_at string, last_sync_at timestamp"))
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}  # two rows
        store.publish({
            "issues": merged,
            "issues_vec": index.replace_rows(vecs, new_vecs, ["issue_id"]),
            "issue_comments": store.table("issue_comments").join(gone, "issue_id", "left_anti").unionByName(talk),
            "relations": edges,
            **bm25.stored(text_index),
            "manifest": store.with_manifest("embedding_fp", fp),
            "sync_state": states,
        })
        return SyncReport(0 if issues is None else issues.count(), counts.get("embed", 0), counts.get("skip", 0), cursor)
    finally:
        touched.unpersist()
