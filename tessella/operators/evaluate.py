"""Ranking evaluation: graded metrics at five, anchors and drift."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvalError

CUT = 5
#: Anchors that disagree by more than this share make a report invalid.
MAX_DRIFT = 0.2
JUDGE_PROMPT = (
    "You grade search results. Given a query and a candidate (title and snippet), answer with JSON only: "
    '{"grade": 0, 1 or 2, "reason": "one sentence"}; 2 answers the query, 1 is related, 0 is not relevant.'
)


def prompt_hash() -> str:
    return hashlib.sha1(JUDGE_PROMPT.encode()).hexdigest()


def per_query(graded: DataFrame) -> DataFrame:
    """query, ndcg5, mrr, hit5, recall5, n_relevant from (query, rank, grade), ranks from 1.

    The ideal order is of all grades; recall is over the relevant among the hits.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "rank"))
    top, relevant = F.col("rank") <= CUT, F.col("grade") > 0
    rows = graded.withColumn("best", best)
    sums = rows.groupBy("query").agg(
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= CUT, gain / F.log2(F.col("best") + 1.0)).otherwise(0.0)).alias("ideal"),
        F.min(F.when(top & relevant, F.col("rank"))).alias("first"),
        F.count(F.when(top & relevant, 1)).alias("found"),
        F.count(F.when(relevant, 1)).alias("n_relevant"),
    )
    return sums.select(
        "query",
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit5"),
        F.when(F.col("n_relevant") > 0, F.col("found") / F.col("n_relevant")).otherwise(0.0).alias("recall5"),
        "n_relevant",
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over queries; recall over those with something relevant."""
    return metrics.agg(
        F.count("*").alias("n_queries"), F.avg("ndcg5").alias("ndcg5"), F.avg("mrr").alias("mrr"), F.avg("hit5").alias("hit5"), F.coalesce(F.avg(F.when(F.col("n_relevant") > 0, F.col("recall5"))), F.lit(0.0)).alias("recall5")
    )


def drift(graded: DataFrame, anchors: DataFrame) -> DataFrame:
    """n_anchors, n_wrong, drift, valid, and up to three samples, of hits (query, repo, number, grade) that anchors expect grades of."""
    both = graded.join(anchors.select("query", "repo", "number", "expected_grade"), ["query", "repo", "number"])
    wrong = F.col("grade") != F.col("expected_grade")
    named = F.concat_ws(" ", "query", F.concat("repo", F.lit("#"), "number"))
    samples = F.slice(F.sort_array(F.collect_set(F.when(wrong, named))), 1, 3)
    share = F.when(F.col("n_anchors") > 0, F.col("n_wrong") / F.col("n_anchors")).otherwise(0.0)
    return both.agg(F.count("*").alias("n_anchors"), F.count(F.when(wrong, 1)).alias("n_wrong"), samples.alias("samples")).withColumn("drift", share).withColumn("valid", F.col("drift") <= MAX_DRIFT)


def queries_of(recent: DataFrame, anchors: DataFrame) -> DataFrame:
    """Recent queries in their order, then those of anchors in theirs, once each, in order."""
    both = recent.select("query").withColumn("_part", F.lit(0)).unionByName(anchors.select("query").withColumn("_part", F.lit(1))).withColumn("_at", F.monotonically_increasing_id())
    first = both.groupBy("query").agg(F.min(F.struct("_part", "_at")).alias("_first"))
    return first.orderBy("_first").select("query")


def judged(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """Hits graded by a fixed table (title, grade); a title without grade is an error."""
    missing = F.raise_error(F.concat(F.lit("no grade for title "), F.col("title"))).cast("int")
    return hits.join(grades.select("title", F.col("grade").alias("_grade")), "title", "left").withColumn("grade", F.when(F.col("_grade").isNull(), missing).otherwise(F.col("_grade").cast("int"))).drop("_grade")


def run(hits: DataFrame, anchors: DataFrame) -> dict:
    """The report over graded hits (query, rank, repo, number, grade): scores and drift as plain values."""
    scores = summary(per_query(hits)).first()
    if not scores.n_queries:
        raise EvalError("no queries to evaluate: search first, or give anchors")
    anchored = drift(hits, anchors).first()
    return {"scores": scores.asDict(), "anchors": anchored.asDict(), "valid": anchored.valid, "prompt_hash": prompt_hash()}
