"""The raw layer: one folder a repository, with issues and comments as compressed JSON lines."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import repo_dir_name
from ..operators.index import latest
from ..schema import RAW_COMMENT, RAW_ISSUE
from .pointer import Pointer

#: Versions that stay readable, for readers that began before the last ones.
KEPT = 3


class RawStore:
    """A table is its merged version and the pages staged since. Pages are durable as soon as they are staged; one merge takes in all of them."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _pointer(self, repo: str, table: str) -> Pointer:
        return Pointer(self.spark, f"{self.home}/raw/{repo_dir_name(repo)}/{table}")

    def _now(self, repo: str, table: str) -> tuple[int, dict, list[str]]:
        """The pointer's number, its value, and the pages that its version lacks."""
        pointer = self._pointer(repo, table)
        number, value = pointer.read()
        value = value or {"version": None, "pages": []}
        return number, value, [p for p in pointer.listed("pages") if p not in value["pages"]]

    def read(self, repo: str, table: str) -> DataFrame:
        """The rows as merged so far, staged pages included. Blank lines are skipped; lines that aren't issues are dropped."""
        schema, needed = (RAW_ISSUE, "number") if table == "issues" else (RAW_COMMENT, "id")
        home = self._pointer(repo, table).folder
        _, value, pages = self._now(repo, table)
        rows = self.spark.createDataFrame([], schema) if value["version"] is None else read_lines(self.spark, f"{home}/{value['version']}", schema, needed)
        if not pages:
            return rows
        staged = self.spark.read.schema(f"{schema}, _at LONG").json([f"{home}/pages/{p}" for p in pages]).where(F.col(needed).isNotNull())
        return merged(rows, staged, table)

    def stage(self, repo: str, table: str, rows: DataFrame) -> None:
        """Land one page's rows; later pages count as newer."""
        home, at = self._pointer(repo, table).folder, time.time_ns()
        rows.withColumn("_at", F.lit(at)).write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{home}/pages/{at:020d}-{uuid.uuid4().hex[:8]}")

    def merge(self, repo: str, table: str) -> DataFrame:
        """Merge all staged pages into a new version; the pages and old versions go."""
        pointer = self._pointer(repo, table)
        number, value, pages = self._now(repo, table)
        if pages:
            order = ("number",) if table == "issues" else ("issue_number", "id")
            version = uuid.uuid4().hex
            self.read(repo, table).sort(*order).write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{pointer.folder}/{version}")
            pointer.swap({"version": version, "pages": pages}, number)
            for p in pages:
                pointer.remove(f"pages/{p}")
            old, kept = pointer.drop_before(KEPT)
            for v in {x["version"] for x in old} - {x["version"] for x in kept} - {None}:
                pointer.remove(v)
        return self.read(repo, table)

    def merge_issues(self, repo: str, incoming: DataFrame) -> DataFrame:
        """An issue takes the incoming row unless the stored one is newer."""
        self.stage(repo, "issues", incoming)
        return self.merge(repo, "issues")

    def merge_comments(self, repo: str, incoming: DataFrame) -> DataFrame:
        """Comments are kept as first seen, by id."""
        self.stage(repo, "comments", incoming)
        return self.merge(repo, "comments")

    def load(self, repo: str) -> DataFrame:
        """Issues with their comments as an array in order of id, empty where there are none."""
        return with_comments(self.read(repo, "issues"), self.read(repo, "comments")).withColumn("repo", F.lit(repo))


def merged(rows: DataFrame, staged: DataFrame, table: str) -> DataFrame:
    """Rows with staged ones (_at: when): the newest of each issue by updated_at, then by when it came; each comment as it came first."""
    both = rows.withColumn("_at", F.lit(0).cast("long")).unionByName(staged)
    if table == "issues":
        return latest(both, ["number"], "updated_at", "_at").drop("_at")
    return latest(both.withColumn("_at", -F.col("_at")), ["id"], "_at").drop("_at")


def read_lines(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """JSON lines, gzip or not; fields that are missing are null, unknown ones are ignored, rows without ``needed`` go."""
    return spark.read.schema(schema).json(path).where(F.col(needed).isNotNull())


def with_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("id", "author", "body")))
    talk = comments.groupBy(F.col("issue_number").alias("number")).agg(F.transform(rows, lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"))).alias("comments"))
    none = F.array().cast("array<struct<author:string,body:string>>")
    return issues.join(talk, "number", "left").withColumn("comments", F.coalesce("comments", none))


def to_raw(issues: DataFrame) -> DataFrame:
    """Issues as they are landed, without id, repository and comments."""
    return issues.select("number", "kind", "title", "body", "state", "labels", "comments_count", "author", "created_at", "updated_at")
