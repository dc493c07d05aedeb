"""Issues with their comments, and the context of one issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY_MAX, COMMENT_MAX, COMMENTS_STOP = 8000, 500, 4000


def gathered(comments: DataFrame, key: str = "issue_id", order: str = "idx") -> DataFrame:
    """The comments of each issue as one array, in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, "author", "body")))
    return comments.groupBy(key).agg(F.transform(rows, lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"))).alias("comments"))


def with_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues with an array of comments, empty where there are none."""
    none = F.array().cast("array<struct<author:string,body:string>>")
    return issues.join(gathered(comments).withColumnRenamed("issue_id", "id"), "id", "left").withColumn("comments", F.coalesce("comments", none))


def rendered(comments: Column) -> Column:
    """Comments as text: lines are added until over 4000 characters are there, so the last line may pass it."""
    line = lambda c: F.concat(F.lit("- "), F.coalesce(c["author"], F.lit("")), F.lit(" "), F.substring(F.coalesce(c["body"], F.lit("")), 1, COMMENT_MAX), F.lit("\n"))
    return F.aggregate(comments, F.lit(""), lambda acc, c: F.when(F.length(acc) > COMMENTS_STOP, acc).otherwise(F.concat(acc, line(c))))


def pack(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """repo, number, title, state, labels, comments_count, updated_at, body, comments as an agent reads them."""
    c = F.coalesce
    return with_comments(issues, comments).select(
        "repo", "number", c("title", F.lit("")).alias("title"), "state", "labels", "comments_count", "updated_at", F.substring(c("body", F.lit("")), 1, BODY_MAX).alias("body"), rendered(F.col("comments")).alias("comments")
    )


def issue(issues: DataFrame, repo: str, number: int) -> DataFrame:
    return issues.where((F.col("repo") == repo) & (F.col("number") == number))


def metas(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some ids, nulls as empty strings."""
    filled = issues.withColumns({k: F.coalesce(k, F.lit("")) for k in ("title", "body", "author", "created_at")}).withColumn("kind", F.coalesce("kind", F.lit("issue")))
    return filled.join(ids.select("id").distinct(), "id", "left_semi")
