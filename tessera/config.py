"""Settings, from the environment or by hand, with their ranges."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import ConfigurationError
from .functions.misc import MOST_RESULTS


@dataclass(frozen=True)
class Settings:
    embedding_url: str
    embedding_key: str
    embedding_model: str
    search_key: str | None = None
    search_engine_id: str | None = None
    search_provider: str = "google"
    data_dir: str | None = None
    similarity_threshold: float = 0.6
    tokens: int = 512
    timeout_ms: int = 20_000
    concurrency: int = 2
    embedding_batch: int = 8

    def __post_init__(self):
        def need(ok, what):
            if not ok:
                raise ConfigurationError(what)

        need(self.embedding_url.startswith(("http://", "https://")), "a valid embedding server URL is required")
        need(self.embedding_key, "an embedding server key is required")
        need(self.embedding_model, "an embedding model name is required")
        need(self.search_provider in MOST_RESULTS, f"unknown search provider: {self.search_provider}")
        need(self.search_provider == "duckduckgo" or self.search_key, f"{self.search_provider} needs a search key")
        need(self.search_provider != "google" or self.search_engine_id, "google needs a search engine id")
        need(0 <= self.similarity_threshold <= 1, "the similarity threshold is from 0 to 1")
        need(self.tokens > 0 and self.timeout_ms > 0, "tokens and timeout are positive")
        need(1 <= self.concurrency <= 10, "concurrency is from 1 to 10")
        need(1 <= self.embedding_batch <= 32, "the embedding batch is from 1 to 32")


#: Names of the settings in the environment.
VARIABLES = {
    "embedding_url": "EMBEDDING_SERVER_URL",
    "embedding_key": "EMBEDDING_SERVER_API_KEY",
    "embedding_model": "EMBEDDING_MODEL_NAME",
    "search_key": "SEARCH_ENGINE_API_KEY",
    "search_engine_id": "GOOGLE_SEARCH_ENGINE_ID",
    "search_provider": "SEARCH_PROVIDER",
    "data_dir": "DATA_DIR",
    "similarity_threshold": "SIMILARITY_THRESHOLD",
    "tokens": "EMBEDDING_TOKENS_SIZE",
    "timeout_ms": "REQUEST_TIMEOUT_MS",
    "concurrency": "CONCURRENCY",
    "embedding_batch": "EMBEDDING_BATCH_SIZE",
}


def from_environment(env: dict[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    values: dict = {"embedding_url": "", "embedding_key": "", "embedding_model": ""}
    for f in fields(Settings):
        raw = env.get(VARIABLES[f.name])
        if raw:
            kind = {"float": float, "int": int}.get(str(f.type), str)
            try:
                values[f.name] = kind(raw)
            except ValueError as e:
                raise ConfigurationError(f"{VARIABLES[f.name]}: {raw}") from e
    return Settings(**values)
