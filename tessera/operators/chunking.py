"""Documents to chunk rows: one Arrow pass, one row a chunk, numbered in document order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..markup import chunking
from .spread import spread

SCHEMA = "id string, url string, section_path array<string>, text string, tokens int, overlap_tokens int, chunk_index int"


def chunk_documents(documents: DataFrame, most_tokens: int = chunking.DEFAULT_TOKENS, overlap: float = chunking.DEFAULT_OVERLAP, structured: bool = True, compat: bool = True) -> DataFrame:
    """Chunks of (url, markdown); blank documents have none."""
    if most_tokens < 1 or not 0 <= overlap < 100:
        raise ValueError("most_tokens must be positive, overlap a percentage below 100")

    def run(batches):
        names = ["id", "url", "section_path", "text", "tokens", "overlap_tokens", "chunk_index"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for url, text in zip(b.column("url").to_pylist(), b.column("markdown").to_pylist(), strict=True):
                found = chunking.chunk(text or "", url or "", most_tokens, overlap, structured, compat)
                rows += [(c.id, url, list(c.path), c.text, c.tokens, c.overlap, i) for i, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return spread(documents.select("url", "markdown")).mapInArrow(run, SCHEMA)


def stored_path(section_path):
    """The path as the store has it: joined, or null if empty."""
    return F.when(F.size(section_path) > 0, F.array_join(section_path, " > "))


def compat_path(section_path):
    """The path at the outer edge: the stored form cut at bars, which it doesn't contain."""
    return F.split(section_path, r"\|")
