"""Hybrid search and related items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from . import bm25, vectors
from .filters import SearchFilter, SearchParams


#: Hits that are broadcast, at most; beyond, the join is left to adaptive execution.
FEW = 10_000


def _few(hits: DataFrame, top_k: int) -> DataFrame:
    return F.broadcast(hits) if top_k <= FEW else hits


def rrf(vec: DataFrame, fts: DataFrame, k: int = 60) -> DataFrame:
    """id, score, source of two ranked legs (id, rank), fused by reciprocal ranks, best first; ties go to the smaller id."""
    both = vec.select("id", F.col("rank").alias("vr")).join(fts.select("id", F.col("rank").alias("fr")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select("id", (part("vr") + part("fr")).alias("score"), source_tag(F.col("vr"), F.col("fr")).alias("source")).orderBy(F.desc("score"), "id")


def source_tag(vec_rank: Column, fts_rank: Column) -> Column:
    return F.when(vec_rank.isNotNull() & fts_rank.isNotNull(), "vec+fts").when(vec_rank.isNotNull(), "vec").otherwise("fts")


def _ranked(df: DataFrame, *order) -> DataFrame:
    """With rank, for a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fused(
    issues: DataFrame, vecs: DataFrame, index: bm25.TextIndex, qvec: Sequence[float], query: str, where: SearchFilter = SearchFilter(), top_k: int = 5, params: SearchParams = SearchParams(), decimals: int | None = None
) -> DataFrame:
    """id, score, source of both legs' fusion; the filter holds on both legs, before their limits."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    vectors.check_dimension(vecs, qvec)
    wanted = where.predicate()
    vec = vectors.top_k(vectors.candidates(issues, vecs, wanted), qvec, params.vec_top, decimals)
    fts = _ranked(bm25.search(index, issues, query, params.fts_top, wanted, decimals), "bm25", "id")
    return rrf(vec, fts, params.rrf_k).limit(top_k)


def hybrid_search(issues: DataFrame, vecs: DataFrame, index: bm25.TextIndex, qvec: Sequence[float], query: str, where: SearchFilter = SearchFilter(), top_k: int = 5, params: SearchParams = SearchParams(), decimals: int | None = None) -> DataFrame:
    """id, repo, number, kind, title, state, snippet, score, source of the best hits.

    There is no similarity floor: the vector leg always gives its share. Wide columns are read
    only for the hits.
    """
    hits = fused(issues, vecs, index, qvec, query, where, top_k, params, decimals)
    wide = issues.select("id", "repo", "number", F.coalesce("kind", F.lit("issue")).alias("kind"), F.coalesce("title", F.lit("")).alias("title"), "state", snippet(F.col("body"), params.snippet_chars).alias("snippet"))
    return _few(hits, top_k).join(wide, "id").select("id", "repo", "number", "kind", "title", "state", "snippet", "score", "source").orderBy(F.desc("score"), "id")


def find_related(issues: DataFrame, vecs: DataFrame, repo: str, number: int, top_k: int = 10, state: str | None = None, decimals: int | None = None) -> DataFrame:
    """id, repo, number, title, score of the issues nearest to a known one, across repositories; empty where it is unknown or has no vector."""
    own = issues.where((F.col("repo") == repo) & (F.col("number") == number)).select("id").join(vecs.select(F.col("issue_id").alias("id"), "embedding"), "id").head(1)
    if not own:
        return issues.select("id", "repo", "number", "title", F.lit(0.0).alias("score")).limit(0)
    others = vectors.candidates(issues, vecs, SearchFilter(state=state).predicate()).where(F.col("id") != own[0].id)
    best = vectors.top_k(others, own[0].embedding, top_k, decimals).select("id", F.col("sim").alias("score"))
    return _few(best, top_k).join(issues.select("id", "repo", "number", "title"), "id").select("id", "repo", "number", "title", "score").orderBy(F.desc("score"), "id")
