"""Duplicate check: retrieval, then a rerank by title similarity with a floor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_similarity
from . import bm25, retrieve
from .filters import SearchFilter, SearchParams

#: The title's weight and the floor, in units of the best possible fused score.
TITLE_WEIGHT, FLOOR = 0.3, 0.6
POOL_FACTOR, POOL_LEAST = 3, 15


def check_duplicate(
    issues: DataFrame, vecs: DataFrame, index: bm25.TextIndex, qvec: Sequence[float], title: str, where: SearchFilter = SearchFilter(), top_k: int = 5, params: SearchParams = SearchParams(), decimals: int | None = None
) -> DataFrame:
    """id, repo, number, kind, title, state, score, title_sim, source of likely duplicates of a draft.

    The full-text leg searches the title alone. A pool larger than top_k is reranked by fused
    score plus title similarity; hits under the floor go; ``score`` stays the fused one.
    """
    pool = retrieve.hybrid_search(issues, vecs, index, qvec, title, where, max(POOL_FACTOR * top_k, POOL_LEAST), params, decimals)
    unit = 2.0 / (params.rrf_k + 1)
    sim = title_similarity(F.lit(title), F.col("title"))
    judged = pool.withColumn("title_sim", sim if decimals is None else F.round(sim, decimals)).withColumn("combined", F.col("score") + TITLE_WEIGHT * unit * F.col("title_sim"))
    kept = judged.where(F.col("combined") >= FLOOR * unit).orderBy(F.desc("combined"), F.desc("score"), "id").limit(top_k)
    return kept.select("id", "repo", "number", "kind", "title", "state", "score", "title_sim", "source")
