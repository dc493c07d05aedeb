"""The five tools over an index, as plain values."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import TessellaError
from .functions import fingerprint, text
from .operators import bm25, context, duplicates, querylog, relations, retrieve
from .operators.filters import SearchFilter, SearchParams
from .schema import FOLLOW_UPS
from .sources.embedder import Embedder
from .sources.store import IndexStore

HIT = ("repo", "number", "kind", "title", "state", "snippet", "score", "source")


class Tools:
    """Search, context, related items, repositories and duplicates. Results are at most a few rows, so they come to the driver."""

    def __init__(self, spark: SparkSession, store: IndexStore, embedder: Embedder, params: SearchParams = SearchParams(), title_repeats: int = text.TITLE_REPEATS, body_max: int = text.BODY_MAX):
        self.spark, self.store, self.embedder, self.params = spark, store, embedder, params
        self.title_repeats, self.body_max = title_repeats, body_max

    def _tables(self):
        issues = self.store.table("issues")
        return issues, self.store.table("issues_vec"), bm25.TextIndex(self.store.table("postings"), self.store.table("lengths"), self.store.table("text_stats"))

    def _guard(self) -> None:
        """The index' vectors must be comparable with the embedder's."""
        stored = self.store.manifest("embedding_fp")
        current = self.embedder.fingerprint()
        if stored and fingerprint.space(stored) != fingerprint.space(current):
            fingerprint.ensure(stored, current)

    def _log(self, hits, tool: str, query: str, filters: str | None) -> None:
        """Append to the log; a search doesn't fail with it."""
        try:
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            self.store.append("query_log", querylog.entry(hits, time.time_ns(), now, tool, query, filters))  # ids in order of time
        except Exception as e:
            import warnings

            warnings.warn(f"the query log can't be written: {e}", stacklevel=2)

    def search_issues(self, query: str, repos: list[str] | None = None, state: str | None = None, labels: list[str] | None = None, top_k: int = 5, tool: str = querylog.SEARCH_TOOL) -> list[dict]:
        self._guard()
        where = SearchFilter(repos, state, labels)
        hits = retrieve.hybrid_search(*self._tables(), self.embedder.embed([query])[0], query, where, top_k, self.params)
        rows = [r.asDict() for r in hits.collect()]
        kept = self.spark.createDataFrame([(r["id"], r["repo"], r["number"], r["score"]) for r in rows], "id long, repo string, number long, score double")
        self._log(kept, tool, query, where.to_json())
        return [{k: r[k] for k in HIT} for r in rows]

    def get_issue_context(self, repo: str, number: int) -> dict:
        issues = self.store.table("issues")
        found = context.pack(context.issue(issues, repo, number), self.store.table("issue_comments")).first()
        if found is None:
            raise TessellaError(f"{repo}#{number} is not in the index")
        mark = querylog.follow_up(self.store.table("query_log"), f"{repo}#{number}", datetime.now(timezone.utc).replace(tzinfo=None)).first()
        if mark:
            self.store.append("follow_ups", self.spark.createDataFrame([tuple(mark)], FOLLOW_UPS))
        keys = self.spark.createDataFrame([(repo, number)], "repo string, number long")
        edges = relations.payload(self.store.table("relations"), keys).first().asDict()
        return found.asDict() | {"related": self.find_related(repo, number, 5), "relations": {k: edges[k] for k in ("fixes", "closes", "refs", "fixed_by")}}

    def find_related(self, repo: str, number: int, top_k: int = 10) -> list[dict]:
        hits = retrieve.find_related(self.store.table("issues"), self.store.table("issues_vec"), repo, number, top_k)
        return [{k: r[k] for k in ("repo", "number", "title", "score")} for r in hits.collect()]

    def list_repos(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in querylog.list_repos(self.store.table("issues"), self.store.table("sync_state")).collect()]

    def check_duplicate(self, title: str, body: str, repos: list[str] | None = None, top_k: int = 5) -> list[dict]:
        self._guard()
        none = F.array().cast("array<struct<author:string,body:string>>")
        draft = self.spark.range(1).select(text.build_text_with_comments(F.lit(title), F.lit(body), none, self.title_repeats, self.body_max)).first()[0]
        where = SearchFilter(repos)
        hits = duplicates.check_duplicate(*self._tables(), self.embedder.embed([draft])[0], title, where, top_k, self.params)
        rows = [r.asDict() for r in hits.collect()]
        kept = self.spark.createDataFrame([(r["id"], r["repo"], r["number"], r["score"]) for r in rows], "id long, repo string, number long, score double")
        self._log(kept, "check_duplicate", title, where.to_json())
        return [{k: r[k] for k in ("repo", "number", "kind", "title", "state", "score", "title_sim", "source")} for r in rows]
