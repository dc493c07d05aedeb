"""Issues and comments from a REST tracker: pages, retries, limits, and pages as rows."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SourceError
from ..schema import COMMENT_PAGE, ISSUE_PAGE
from .embedder import opener

SPACING_S, LOW_QUOTA, MAX_LIMITED = 0.2, 200, 3
BACKOFF_S = (2, 4, 8)


def parse_issues(pages: DataFrame) -> DataFrame:
    """Rows of issue pages (repo, json): nulls as defaults, labels as names, pull requests told apart."""
    row = pages.select("repo", F.inline(F.from_json("json", ISSUE_PAGE)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    return row.select(
        "repo", "number", F.when(F.col("pull_request").isNotNull(), "pr").otherwise("issue").alias("kind"), text("title").alias("title"), text("body").alias("body"), "state", names.alias("labels"),
        F.coalesce(F.col("user.login"), F.lit("")).alias("author"), F.coalesce("comments", F.lit(0).cast("long")).alias("comments_count"), text("created_at").alias("created_at"), text("updated_at").alias("updated_at"),
    )


def parse_comments(pages: DataFrame) -> DataFrame:
    """Rows of comment pages (json): blank ones, and those of no issue, are dropped."""
    row = pages.select(F.inline(F.from_json("json", COMMENT_PAGE)))
    number = issue_number(F.col("issue_url"))
    out = row.select("id", number.alias("issue_number"), F.coalesce(F.col("user.login"), F.lit("")).alias("author"), "body", F.coalesce("created_at", F.lit("")).alias("created_at"))
    return out.where(F.col("issue_number").isNotNull() & (F.trim(F.coalesce("body", F.lit(""))) != ""))


def issue_number(url):
    return F.element_at(F.split(url, "/"), -1).try_cast("bigint")


def next_link(header: str | None) -> str | None:
    """The address of the next page, from a Link header."""
    for part in (header or "").split(","):
        address, _, params = part.partition(";")
        if any(p.strip().replace('"', "") == "rel=next" for p in params.split(";")):
            return address.strip().strip("<>")
    return None


def limited_wait(headers: dict[str, str], now: float) -> float:
    """Seconds until the quota is renewed, if little is left of it."""
    left, reset = headers.get("x-ratelimit-remaining"), headers.get("x-ratelimit-reset")
    return max(0.0, float(reset) - now) if left is not None and reset is not None and int(left) < LOW_QUOTA else 0.0


def retry_after(headers: dict[str, str], default: float = 60.0) -> float:
    try:
        return max(0.0, float(headers.get("retry-after", default)))
    except ValueError:
        return default


class Rest:
    """Pages of a REST tracker; transport, clock and sleep can be given, so tests need no network."""

    def __init__(self, base: str, token: str | None = None, get: Callable | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time, proxy: str | None = None):
        self.base, self.token, self.sleep, self.now = base.rstrip("/"), token, sleep, now
        self._get, self._last, self._opener = get or self._http, -1e9, opener(proxy)

    def _http(self, url: str) -> tuple[int, dict[str, str], str]:
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with self._opener.open(urllib.request.Request(url, headers=headers), timeout=60) as r:
                return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode(errors="replace")

    def fetch(self, url: str) -> tuple[dict[str, str], str]:
        """One page: spaced requests, waits where limited, and three more tries after transport errors."""
        limited = failed = 0
        while True:
            wait = self._last + SPACING_S - self.now()
            if wait > 0:
                self.sleep(wait)
            self._last = self.now()
            try:
                status, headers, body = self._get(url)
            except OSError as e:
                if failed == len(BACKOFF_S):
                    raise SourceError(f"{url}: {e}") from e
                self.sleep(BACKOFF_S[failed])
                failed += 1
                continue
            if status in (403, 429) and limited < MAX_LIMITED:
                limited += 1
                self.sleep(retry_after(headers))
                continue
            if status >= 400:
                raise SourceError(f"{url}: status {status}")
            wait = limited_wait(headers, self.now())
            if wait:
                self.sleep(wait)
            return headers, body

    def pages(self, url: str) -> Iterator[str]:
        while url:
            headers, body = self.fetch(url)
            json.loads(body)  # a page that isn't JSON fails here rather than in a job
            yield body
            url = next_link(headers.get("link"))

    def issue_pages(self, repo: str, since: str | None = None) -> Iterator[str]:
        yield from self.pages(f"{self.base}/repos/{repo}/issues?state=all&per_page=100" + (f"&since={since}" if since else ""))

    def comment_pages(self, repo: str, since: str | None = None) -> Iterator[str]:
        yield from self.pages(f"{self.base}/repos/{repo}/issues/comments?per_page=100" + (f"&since={since}" if since else ""))
