"""Errors of the library: what failed, and whether a retry can help."""

from __future__ import annotations


class TesseraError(Exception):
    kind = "error"
    retryable = False


class ConfigurationError(TesseraError):
    kind = "configuration"


class ValidationError(TesseraError):
    kind = "validation"


class NetworkError(TesseraError):
    kind, retryable = "network", True


class ExtractionError(TesseraError):
    kind = "extraction"


class EmbeddingError(TesseraError):
    kind = "embedding"

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message if status is None else f"{message} (status {status})")
        self.status, self.retryable = status, status == 429


class StoreError(TesseraError):
    kind, retryable = "database", True


class RateLimitError(TesseraError):
    kind, retryable = "rate_limit", True
