"""The graph of mentions: extraction from text, look-ups in both directions, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where sentences end, what a name is made of, and the words that give a mention its kind.
SENTENCE_END = r"[\n\r。!?.;,]"
WORD = "[A-Za-z0-9_.-]"
MENTION = rf"(?:({WORD}+/{WORD}+)|(?<!{WORD}))#([0-9]+)(?!{WORD})"
FIXES = r"(?i)(?<![a-z0-9])(fix|fixes|fixed|resolve|resolves)(?![a-z0-9])|修复|解决"
CLOSES = r"(?i)(?<![a-z0-9])(close|closes|closed)(?![a-z0-9])|关闭"


def sentence_kind(sentence: Column) -> Column:
    return F.when(sentence.rlike(FIXES), "fixes").when(sentence.rlike(CLOSES), "closes").otherwise("refs")


def extract(issues: DataFrame) -> DataFrame:
    """repo, number, kind, target_repo, target_number of every mention in title and body.

    A sentence's key word holds for all its mentions; ``owner/name#n`` names another repository;
    mentions of the issue itself are left out. A number too large for a long is 0.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    sentences = issues.where(text.contains("#")).select("repo", "number", F.explode(F.split(text, SENTENCE_END, -1)).alias("sentence")).where(F.col("sentence").contains("#"))
    found = F.arrays_zip(F.regexp_extract_all("sentence", F.lit(MENTION), F.lit(1)).alias("to"), F.regexp_extract_all("sentence", F.lit(MENTION), F.lit(2)).alias("n"))
    mentions = sentences.select("repo", "number", sentence_kind(F.col("sentence")).alias("kind"), F.explode(found).alias("m"))
    edges = mentions.select(
        "repo", "number", "kind", F.when(F.col("m.to") == "", F.col("repo")).otherwise(F.col("m.to")).alias("target_repo"), F.coalesce(F.expr("try_cast(m.n AS BIGINT)"), F.lit(0).cast("long")).alias("target_number")
    )
    return edges.where((F.col("target_repo") != F.col("repo")) | (F.col("target_number") != F.col("number"))).distinct()


def replace(relations: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Relations after those of the ``touched`` issues (repo, number) are replaced by ``new`` ones; none clears them."""
    return relations.join(touched.select("repo", "number").distinct(), ["repo", "number"], "left_anti").unionByName(new).distinct()


def of(relations: DataFrame, repo: str, number: int) -> DataFrame:
    """What an issue mentions."""
    return relations.where((F.col("repo") == repo) & (F.col("number") == number)).orderBy("kind", "target_repo", "target_number")


def reverse(relations: DataFrame, repo: str, number: int) -> DataFrame:
    """What mentions an issue."""
    return relations.where((F.col("target_repo") == repo) & (F.col("target_number") == number)).orderBy("repo", "number", "kind")


def payload(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """For each of ``keys`` (repo, number): fixes, closes, refs and fixed_by, as sorted arrays of "repo#number"; empty where there are none."""
    name = lambda r, n: F.concat(F.col(r), F.lit("#"), F.col(n))
    collected = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, name("target_repo", "target_number")))).alias(kind)
    forward = relations.groupBy("repo", "number").agg(*map(collected, ("fixes", "closes", "refs")))
    back = relations.where("kind = 'fixes'").groupBy(F.col("target_repo").alias("repo"), F.col("target_number").alias("number")).agg(F.sort_array(F.collect_set(name("repo", "number"))).alias("fixed_by"))
    none = F.array().cast("array<string>")
    out = keys.select("repo", "number").join(forward, ["repo", "number"], "left").join(back, ["repo", "number"], "left")
    return out.select("repo", "number", *[F.coalesce(c, none).alias(c) for c in ("fixes", "closes", "refs", "fixed_by")])
