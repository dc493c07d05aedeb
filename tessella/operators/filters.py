"""Predicates that both search legs share."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(array: str, want: str) -> Column:
    return F.exists(array, lambda x: F.lower(x) == want)


@dataclass(frozen=True)
class SearchFilter:
    """``repos`` None is no restriction, an empty list matches nothing; labels must all be there, whatever their case."""

    repos: list[str] | None = None
    state: str | None = None
    labels: list[str] | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.repos is not None:
            out = out & (F.col("repo").isin(self.repos) if self.repos else F.lit(False))
        if self.state not in (None, "all"):
            out = out & (F.col("state") == self.state)
        for label in self.labels or []:
            out = out & F.coalesce(_has("labels", label.lower()), F.lit(False))
        return out

    def to_json(self) -> str:
        """For the query log; what isn't set is null."""
        return json.dumps({"repos": self.repos, "state": self.state, "labels": self.labels}, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class SearchParams:
    vec_top: int = 30
    fts_top: int = 30
    rrf_k: int = 60
    snippet_chars: int = 200
