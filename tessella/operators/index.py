"""Index maintenance: upserts, incremental decisions, and what they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered

KEY = ["repo", "number"]


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` (repo, number, and further columns of issues) put in.

    Known keys keep their id; new ones get the ids after the greatest, in order of their keys. A
    column that ``new`` lacks keeps its value.
    """
    start = F.coalesce(F.max("id"), F.lit(0)).alias("_start")
    fresh = new.join(old.select(*KEY), KEY, "left_anti").select(*KEY)
    ranked = numbered(fresh, *KEY).crossJoin(F.broadcast(old.agg(start))).select(*KEY, (F.col("_start") + F.col("_at") + 1).alias("_id"))  # one row
    given = new.columns
    taken = F.col("_new").isNotNull()
    out = [F.coalesce(F.col("o.id"), F.col("_id")).alias("id")]
    merged = old.alias("o").join(new.withColumn("_new", F.lit(True)).join(ranked, KEY, "left").alias("n"), KEY, "full_outer")
    for c in old.columns:
        if c == "id":
            continue
        if c in KEY:
            out.append(F.col(c))
        elif c in given:
            out.append(F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return merged.select(*out).select(*old.columns)


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows of the keys in ``new``, and the rows of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def latest(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """One row a key: the greatest by ``order``, and of equals the one with the greatest other columns, so that no run differs."""
    others = [c for c in rows.columns if c not in key]
    comparable = [c for c, kind in rows.dtypes if c in others and "map<" not in kind and kind != "variant"]
    best = F.max_by(F.struct(*others), F.struct(F.struct(*order), F.struct(*comparable))).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def decide(hashed: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """repo, number, hash, action of issues (repo, number, hash): 'skip' where the hash is known and there is a vector, else 'embed'."""
    state = old.select("id", *KEY, "embedded_hash").join(vectors.select(F.col("issue_id").alias("id"), F.lit(True).alias("_vec")), "id", "left")
    both = hashed.join(state, KEY, "left")
    known = F.col("embedded_hash").eqNullSafe(F.col("hash")) & F.coalesce("_vec", F.lit(False))
    return both.select(*KEY, "hash", F.when(known, "skip").otherwise("embed").alias("action"))


def touched(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Numbers of the issues that were fetched or commented."""
    return issues.select("number").union(comments.select(F.col("issue_number").alias("number"))).distinct()


def has_vector(issues: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, embedded_hash, has_vec."""
    flag = vectors.select(F.col("issue_id").alias("id"), F.lit(True).alias("_vec")).distinct()
    return issues.join(flag, "id", "left").select("id", "embedded_hash", F.coalesce("_vec", F.lit(False)).alias("has_vec"))
