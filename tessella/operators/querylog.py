"""The query log: entries, follow-ups, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

SEARCH_TOOL = "search_issues"


def entry(hits: DataFrame, entry_id: int, ts, tool: str, query: str, filters: str | None) -> DataFrame:
    """A log row; its results are "repo#number" in the hits' order."""
    named = F.concat(F.col("repo"), F.lit("#"), F.col("number"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", named.alias("r"))))
    return hits.agg(F.transform(order, lambda x: x["r"]).alias("results")).select(
        F.lit(entry_id).cast("long").alias("id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(tool).alias("tool"), F.lit(query).alias("query"), F.lit(filters).alias("filters"), "results", F.lit(None).cast("string").alias("follow_up")
    )


def follow_up(log: DataFrame, target: str, at) -> DataFrame:
    """log_id, follow_up, at: the mark of the latest search whose results hold ``target``; no row where there is none."""
    found = log.where((F.col("tool") == SEARCH_TOOL) & F.array_contains("results", target)).agg(F.max("id").alias("log_id"))
    return found.where("log_id IS NOT NULL").select("log_id", F.lit(target).alias("follow_up"), F.lit(at).cast("timestamp").alias("at"))


def marked(log: DataFrame, marks: DataFrame) -> DataFrame:
    """The log with the latest of its marks (log_id, follow_up, at)."""
    last = marks.groupBy("log_id").agg(F.max_by("follow_up", F.struct("at", "follow_up")).alias("_mark"))
    return log.join(last, log.id == last.log_id, "left").withColumn("follow_up", F.coalesce("_mark", "follow_up")).drop("log_id", "_mark")


def mark_follow_up(log: DataFrame, target: Column | str) -> DataFrame:
    """The log with the latest search whose results hold ``target`` marked by it; unchanged where there is none."""
    target = F.lit(target) if isinstance(target, str) else target
    latest = log.where((F.col("tool") == SEARCH_TOOL) & F.array_contains("results", target)).agg(F.max("id").alias("_latest"))
    return log.crossJoin(F.broadcast(latest)).withColumn("follow_up", F.when(F.col("id") == F.col("_latest"), target).otherwise(F.col("follow_up"))).drop("_latest")  # one row


def within(log: DataFrame, days: int, now) -> DataFrame:
    """The entries of the last days; the bound itself is in."""
    return log.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval({int(days)})"))


def recent_queries(log: DataFrame, days: int, now) -> DataFrame:
    """Distinct queries of searches, sorted."""
    return within(log, days, now).where(F.col("tool") == SEARCH_TOOL).select("query").distinct().orderBy("query")


@dataclass
class Report:
    """``totals``: total, unique_queries, follow_ups, follow_up_rate. ``top``: query, n. ``by_tool``: tool, n."""

    totals: DataFrame
    top: DataFrame
    by_tool: DataFrame


def report(log: DataFrame, days: int, now, top: int = 10) -> Report:
    part = within(log, days, now)
    totals = part.agg(F.count("*").alias("total"), F.countDistinct("query").alias("unique_queries"), F.count("follow_up").alias("follow_ups"))
    rate = F.when(F.col("total") > 0, F.col("follow_ups") / F.col("total")).otherwise(0.0)
    return Report(
        totals.withColumn("follow_up_rate", rate),
        part.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(top),
        part.groupBy(F.coalesce("tool", F.lit("-")).alias("tool")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool"),
    )


def repo_stats(issues: DataFrame, sync_state: DataFrame) -> DataFrame:
    """repo, issues, last_sync ('-' where there was none)."""
    synced = sync_state.groupBy("repo").agg(F.max("last_sync_at").alias("last"))
    return issues.groupBy("repo").agg(F.count("*").alias("issues")).join(synced, "repo", "left").select("repo", "issues", F.coalesce(F.col("last").cast("string"), F.lit("-")).alias("last_sync")).orderBy("repo")


def label_facets(issues: DataFrame) -> DataFrame:
    """repo, label, n; frequent labels first."""
    return issues.select("repo", F.explode("labels").alias("label")).groupBy("repo", "label").agg(F.count("*").alias("n")).orderBy("repo", F.desc("n"), "label")


def list_repos(issues: DataFrame, sync_state: DataFrame) -> DataFrame:
    """repo, issues, last_sync, labels (name, count), frequent labels first."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "label")))
    facets = label_facets(issues).groupBy("repo").agg(F.transform(order, lambda x: F.struct(x["label"].alias("name"), (-x["minus"]).alias("count"))).alias("labels"))
    none = F.array().cast("array<struct<name:string,count:bigint>>")
    return repo_stats(issues, sync_state).join(facets, "repo", "left").withColumn("labels", F.coalesce("labels", none)).orderBy("repo")


def evenly(hits: DataFrame, k: int, *order: str) -> DataFrame:
    """``k`` rows at even steps over the order, the first included; it should be total."""
    total = hits.count()
    if total == 0 or k <= 0:
        return hits.limit(0)
    stride = max(1, total // min(k, total))
    return numbered(hits, *order).where((F.col("_at") % stride == 0) & (F.col("_at") < stride * k)).drop("_at")
