"""Vector search: exact top-k for one query, and for many at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions.vector import dot

#: Queries that travel to every task, at most; a batch over this is split.
MAX_BATCH = 4096
#: Products of queries and candidates that a task holds at a time, about.
PRODUCTS = 1 << 20


def candidates(issues: DataFrame, vectors: DataFrame, predicate=None) -> DataFrame:
    """id and embedding of the issues that have a vector and pass the filter; the filter runs before any product."""
    kept = issues if predicate is None else issues.where(predicate)
    return kept.select("id").join(vectors.select(F.col("issue_id").alias("id"), "embedding"), "id")


def check_dimension(vectors: DataFrame, query: Sequence[float]) -> None:
    """DimensionMismatch if the query hasn't the length of the vectors; nothing where there are none."""
    row = vectors.select(F.size("embedding").alias("n")).first()
    if row is not None and row.n != len(query):
        raise DimensionMismatch(f"the index has vectors of {row.n} dimensions, the query {len(query)}")


def top_k(cands: DataFrame, query: Sequence[float], k: int, decimals: int | None = None) -> DataFrame:
    """id, sim, rank of the ``k`` nearest by inner product; ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = dot(F.col("embedding"), q)
    scored = cands.select("id", (sim if decimals is None else F.round(sim, decimals)).alias("sim"))
    best = scored.orderBy(F.desc("sim"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "id")))  # over k rows


def top_k_batch(cands: DataFrame, queries: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """qid, id, sim, rank for each query (qid, embedding).

    Queries are multiplied with blocks of candidates inside tasks, each of which keeps its own k
    best of every query, so the shuffle carries k rows a query and task. ``queries`` is collected
    in batches of MAX_BATCH.
    """
    spark = cands.sparkSession
    rows = queries.select("qid", "embedding").orderBy("qid").collect() if queries.count() <= MAX_BATCH else None
    if rows is None:
        numbered = queries.withColumn("_part", F.pmod(F.xxhash64("qid"), F.lit(-(-queries.count() // (MAX_BATCH // 2)))))
        parts = [r[0] for r in numbered.select("_part").distinct().collect()]
        out = [top_k_batch(cands, numbered.where(F.col("_part") == p).drop("_part"), k, decimals) for p in parts]
        whole = out[0]
        for more in out[1:]:
            whole = whole.unionByName(more)
        return whole
    if not rows:
        return spark.createDataFrame([], "qid long, id long, sim double, rank int")
    qids = np.array([r.qid for r in rows], np.int64)
    table = np.array([r.embedding for r in rows], np.float64)

    def run(batches):
        import pandas as pd

        sims, ids = np.full((len(qids), 0), 0.0), np.full((len(qids), 0), 0, np.int64)
        rows = max(k, PRODUCTS // len(qids))
        for b in (b.iloc[at : at + rows] for b in batches for at in range(0, len(b), rows)):
            got = table @ np.stack(b["embedding"]).astype(np.float64).T
            if decimals is not None:
                got = np.round(got, decimals)
            sims = np.concatenate([sims, got], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(b["id"].to_numpy(), got.shape)], axis=1)
            order = np.lexsort((ids, -sims))[:, :k]
            sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
        n = sims.shape[1]
        yield pd.DataFrame({"qid": np.repeat(qids, n), "id": ids.ravel(), "sim": sims.ravel()})

    near = cands.select("id", "embedding").mapInPandas(run, "qid long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
