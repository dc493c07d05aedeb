"""Embedders: the protocol, deterministic ones, and one over HTTP; judges alike."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from ..errors import EvalError, SourceError
from ..operators.evaluate import JUDGE_PROMPT

BATCH = 64


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def fingerprint(self) -> str: ...


def unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm > 0 else v


class BagOfWords:
    """Counts of words by a djb2 hash, scaled to length one; for tests."""

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.split():
                h = 5381
                for byte in word.encode():
                    h = (h * 33 + byte) & 0xFFFFFFFFFFFFFFFF
                v[h % self.dim] += 1
            out.append(unit(v).astype(np.float32).tolist())
        return out

    def fingerprint(self) -> str:
        return f"words[dim={self.dim}]|test|len=512"


class ContentHash:
    """A vector made of a stable 64-bit hash's bytes, over and over, each place a little greater than the one before; for tests."""

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        seeds = (np.frombuffer(hashlib.blake2b(t.encode(), digest_size=8).digest(), np.uint8) for t in texts)
        return [((np.resize(s, self.dim).astype(np.float64) - 128) / 128 + np.arange(self.dim) * 1e-6).astype(np.float32).tolist() for s in seeds]

    def fingerprint(self) -> str:
        return f"hash[dim={self.dim}]|test|len=512"


class HttpEmbedder:
    """An endpoint of the common embeddings format; waits 1, 2 and 4 s where limited."""

    def __init__(self, base: str, key: str, model: str, dimensions: int | None = None, batch: int = BATCH, timeout: float = 60, interval: float = 0.0, proxy: str | None = None):
        """``interval``: seconds between the beginnings of two calls of one task."""
        self.base, self.key, self.model, self.dimensions, self.batch, self.timeout = base.rstrip("/"), key, model, dimensions, batch, timeout
        self.interval, self.proxy, self._last = interval, proxy, -1e9

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            part = texts[k : k + self.batch]
            time.sleep(max(0.0, self._last + self.interval - time.monotonic()))
            self._last = time.monotonic()
            body = {"model": self.model, "input": part} | ({"dimensions": self.dimensions} if self.dimensions else {})
            data = sorted(_post(f"{self.base}/embeddings", self.key, body, self.timeout, self.proxy)["data"], key=lambda d: d.get("index", 0))
            if len(data) != len(part):
                raise SourceError(f"{len(data)} vectors for {len(part)} texts")
            out += [unit(np.asarray(d["embedding"], np.float64)).astype(np.float32).tolist() for d in data]
        return out

    def fingerprint(self) -> str:
        dim = f"[dim={self.dimensions}]" if self.dimensions else ""
        return f"{self.model}{dim}|api|len=512"


def opener(proxy: str | None = None) -> urllib.request.OpenerDirector:
    """Requests through a proxy, or the environment's if none is given."""
    return urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy}) if proxy else urllib.request.ProxyHandler())


def _post(url: str, key: str, body: dict, timeout: float, proxy: str | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for wait in (1, 2, 4, None):
        try:
            with opener(proxy).open(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code != 429 or wait is None:
                raise SourceError(f"{url}: status {e.code}") from e
            time.sleep(wait)
    raise SourceError(url)


class HttpJudge:
    """Grades (grade, reason) from a chat endpoint; one more try after a failure; a grade over 2 is an error."""

    def __init__(self, base: str, key: str, model: str, timeout: float = 60):
        self.base, self.key, self.model, self.timeout = base.rstrip("/"), key, model, timeout

    def grade(self, query: str, title: str, snippet: str) -> tuple[int, str | None]:
        body = {
            "model": self.model, "temperature": 0, "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": JUDGE_PROMPT}, {"role": "user", "content": f"query: {query}\ntitle: {title}\nsnippet: {snippet}"}],
        }
        for last in (False, True):
            try:
                return parse_grade(_post(f"{self.base}/chat/completions", self.key, body, self.timeout)["choices"][0]["message"]["content"])
            except (OSError, SourceError, KeyError) as e:
                if last:
                    raise EvalError(str(e)) from e
        raise EvalError("no grade")


def parse_grade(content: str) -> tuple[int, str | None]:
    try:
        made = json.loads(content.strip())
    except ValueError as e:
        raise EvalError(f"not JSON: {content}") from e
    if made.get("grade") not in (0, 1, 2):
        raise EvalError(f"no grade from 0 to 2: {made.get('grade')}")
    return made["grade"], made.get("reason")


def embed(texts: DataFrame, embedder: Embedder, key: str = "id", batch: int = BATCH) -> DataFrame:
    """``key``, embedding of (``key``, text): calls of at most ``batch`` texts, inside tasks."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({key: part[key], "embedding": embedder.embed(part["text"].tolist())})

    return texts.select(key, "text").mapInPandas(run, f"{key} long, embedding array<float>")
