"""Settings: environment over file over preset."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

from .errors import ConfigError
from .functions.text import BODY_MAX, TITLE_REPEATS
from .operators.filters import SearchParams

#: Public embedding endpoints, their models, and the texts that one call takes.
PRESETS = {
    "siliconflow": ("https://api.siliconflow.cn/v1", "BAAI/bge-m3", 64),
    "aliyun": ("https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen3.7-text-embedding-flash", 16),
    "ollama": ("http://127.0.0.1:11434/v1", "bge-m3", 16),
    "openai": ("https://api.openai.com/v1", "text-embedding-3-small", 16),
    "jina": ("https://api.jina.ai/v1", "jina-embeddings-v3", 16),
}
DEFAULT_PROVIDER = "siliconflow"
OWN_BATCH = 16


@dataclass(frozen=True)
class Embedding:
    base: str
    key: str
    model: str
    dimensions: int | None
    batch_size: int


class Config:
    """Settings of one home folder; ``environment`` is the process' unless given. A file that can't be read counts as empty."""

    def __init__(self, home: str | None = None, environment: dict[str, str] | None = None):
        self.env = dict(os.environ) if environment is None else environment
        self.home = Path(home or self.env.get("TESSELLA_HOME") or Path(self.env.get("HOME", "")) / ".tessella")
        try:
            self.file = tomllib.loads((self.home / "config.toml").read_text())
        except (OSError, tomllib.TOMLDecodeError):
            self.file = {}

    def _section(self, name: str) -> dict:
        part = self.file.get(name)
        return part if isinstance(part, dict) else {}

    def embedding(self) -> Embedding:
        part = self._section("embedding")
        provider = self.env.get("TESSELLA_EMBEDDER") or part.get("provider") or DEFAULT_PROVIDER
        if provider not in PRESETS and provider != "custom":
            raise ConfigError(f"unknown provider {provider}: one of {', '.join(PRESETS)} or custom")
        base, model, batch = PRESETS.get(provider, ("", "", OWN_BATCH))
        base = self.env.get("TESSELLA_API_BASE") or part.get("base_url") or base
        model = self.env.get("TESSELLA_API_MODEL") or part.get("model") or model
        if not base or not model:
            raise ConfigError("a custom provider needs base_url and model")
        key = self.env.get("TESSELLA_API_KEY") or part.get("api_key") or ""
        return Embedding(base, key, model, part.get("dimensions"), part.get("batch_size") or batch)

    def search(self) -> SearchParams:
        part, d = self._section("retrieval"), SearchParams()
        return SearchParams(**{k: part.get(k, getattr(d, k)) for k in ("vec_top", "fts_top", "rrf_k", "snippet_chars")})

    def text(self) -> tuple[int, int]:
        part = self._section("retrieval")
        return part.get("title_repeats", TITLE_REPEATS), part.get("body_max_chars", BODY_MAX)

    def evaluation(self) -> dict:
        part = self._section("eval")
        return {"days": part.get("days", 7), "top_k": part.get("top_k", 5), **{k: part.get(k) for k in ("base_url", "api_key", "model")}}

    def token(self) -> str | None:
        value = self.env.get("GITHUB_TOKEN") or self.file.get("token")
        return value if value and value.strip() else None

    def repos(self) -> list[str]:
        return list(self.file.get("repos") or [])

    def batch_interval_ms(self) -> int:
        return self._section("embedding").get("batch_interval_ms", 4000)

    def proxy(self) -> str | None:
        from .sources.skeleton import proxy_of

        return proxy_of(self.env, self._section("network").get("proxy"))
