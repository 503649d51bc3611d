"""Content hashes and stable chunk ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F


def content_hash(text):
    return F.sha2(text.cast("binary"), 256)


def chunk_id(url, section_path, text):
    """SHA-256 of url, section path (joined by slashes) and text, joined by bars."""
    return content_hash(F.concat(url, F.lit("|"), F.array_join(section_path, "/"), F.lit("|"), text))


def chunk_id_of(url: str, section_path: list[str], text: str) -> str:
    return hashlib.sha256(f"{url}|{'/'.join(section_path)}|{text}".encode()).hexdigest()
