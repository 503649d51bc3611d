"""Limits, time ranges, names, dates, option maps, and search-error classes."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

#: Time range codes of the providers.
TIME_RANGES = {
    "google": {"day": "d1", "week": "w1", "month": "m1", "year": "y1"},
    "brave": {"day": "pd", "week": "pw", "month": "pm", "year": "py"},
}
#: Most results a query, by provider.
MOST_RESULTS = {"google": 10, "brave": 20, "duckduckgo": 50, "tavily": 20}
DEFAULT_RESULTS = 5
#: Words that make an option a secret.
SECRET_WORDS = ("password", "token", "secret", "key", "authorization")


def clamp(value, most, default: int = DEFAULT_RESULTS):
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(1)), most if not isinstance(most, int) else F.lit(most))


def time_range(provider: str, value):
    """The provider's code of a range, or null."""
    out = F.lit(None).cast("string")
    for name, code in TIME_RANGES.get(provider, {}).items():
        out = F.when(value == name, code).otherwise(out)
    return out


def model_directory(model: str) -> str:
    """A model name as a directory name."""
    return re.sub("[^a-z0-9]+", "-", model.lower()).strip("-")


def model_directory_column(model):
    return F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cutoff(now, days: int):
    if days < 0:
        raise ValueError("days must not be negative")
    return now - F.make_dt_interval(F.lit(days))


def format_bytes(n: float) -> str:
    """1024-based size with two decimals at most, GB at most."""
    units = ("Bytes", "KB", "MB", "GB")
    k = 0
    while n >= 1024 and k + 1 < len(units):
        n, k = n / 1024, k + 1
    return f"{round(n, 2):.2f}".rstrip("0").rstrip(".") + f" {units[k]}"


def redact(options: dict) -> dict:
    """A copy of an option map with secrets hidden, at any depth."""
    hidden = lambda k: any(w in k.lower() for w in SECRET_WORDS)
    return {k: "[REDACTED]" if hidden(k) else redact(v) if isinstance(v, dict) else v for k, v in options.items()}


def error_class(message):
    """struct(error_type, retryable) of a search failure's message; the first kind that fits counts."""
    has = lambda *marks: reduce(or_, [message.contains(m) for m in marks])
    kinds = [
        (has("timeout", "ECONNRESET"), "network", F.lit(True)),
        (has("status") & message.rlike("[0-9]{3}"), "embedding", F.regexp_extract(message, "status ([0-9]+)", 1) == "429"),
        (has("database", "connection"), "database", F.lit(True)),
        (has("rate", "429"), "rate_limit", F.lit(True)),
    ]
    out = F.struct(F.lit("embedding").alias("error_type"), F.lit(False).alias("retryable"))
    for fits, name, retry in reversed(kinds):
        out = F.when(fits, F.struct(F.lit(name).alias("error_type"), retry.alias("retryable"))).otherwise(out)
    return out
