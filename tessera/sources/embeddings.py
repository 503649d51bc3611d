"""Embedding providers, driven by ``mapInPandas`` so that a text and its vector never part.

A provider turns a list of texts into a list of equally long vectors. Empty input gives empty output;
a wrong count, a missing vector or a change of dimension is an error. Server errors are tried once
more, client errors (429 among them) never.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import ConfigurationError, EmbeddingError

BATCH, MOST_BATCH = 8, 32


class EmbeddingProvider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic vectors without a model: signed hashes of lower-cased words, unit length."""

    def __init__(self, dim: int = 64, model: str = "local-hash"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return out


class HttpProvider:
    """An embeddings endpoint that takes {model, input[]} and answers {data: [{index, embedding}]}."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 20.0, send: Callable | None = None):
        if not (url and key and model):
            raise ConfigurationError("url, key and model are required")
        self.url, self.key, self.model, self.timeout, self.send = url.rstrip("/"), key, model, timeout, send or self._post

    def _post(self, body: dict) -> tuple[int, dict]:
        data = json.dumps(body).encode()
        call = urllib.request.Request(f"{self.url}/v1/embeddings", data, {"content-type": "application/json", "authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, {}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        status, answer = self.send({"model": self.model, "input": texts})
        if status >= 500:
            time.sleep(random.uniform(0.5, 1.5))
            status, answer = self.send({"model": self.model, "input": texts})
        if status >= 400:
            raise EmbeddingError("embedding request failed", status)
        data = answer.get("data")
        if not isinstance(data, list) or len(data) != len(texts):
            raise EmbeddingError("the answer doesn't have one embedding for each text")
        rows = sorted(data, key=lambda d: d.get("index", 0))
        if any(not isinstance(d.get("embedding"), list) for d in rows):
            raise EmbeddingError("an embedding is missing")
        return [d["embedding"] for d in rows]


def provider(kind: str, **options) -> EmbeddingProvider:
    known = {"http": HttpProvider, "hash": HashProvider}
    if kind not in known:
        raise ConfigurationError(f"unknown embedding provider: {kind}")
    return known[kind](**options)


def embed_column(rows: DataFrame, source: EmbeddingProvider, text: str = "text", batch: int = BATCH) -> DataFrame:
    """All columns, ``embedding`` and ``error``: a failing request leaves its rows without a vector and says why."""
    if not 1 <= batch <= MOST_BATCH:
        raise ValueError(f"batch must be from 1 to {MOST_BATCH}")

    def run(frames):
        dim = None
        for f in frames:
            vectors, errors = [], []
            for i in range(0, len(f), batch):
                texts = f[text].iloc[i : i + batch].fillna("").tolist()
                try:
                    got = source.embed(texts)
                    sizes = {len(v) for v in got}
                    if len(got) != len(texts) or len(sizes) > 1 or (dim is not None and sizes and sizes != {dim}):
                        raise EmbeddingError("embeddings differ in number or dimension")
                    dim = dim if dim is not None or not sizes else sizes.pop()
                    vectors += got
                    errors += [None] * len(texts)
                except (EmbeddingError, OSError) as e:
                    vectors += [None] * len(texts)
                    errors += [str(e)] * len(texts)
            yield f.assign(embedding=pd.Series(vectors, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>, error string")
