"""The corpus pipeline: five stages, each one an operator over all that the stage before it kept.

``documents`` -> language ID -> line dedup -> near-duplicates -> benchmark passages -> source mix.

Defined cases: rows with null or empty text go at language ID, as they have no letter; a null id is a
document like others (near-duplicates keep one row of each of its texts); a null source is a source;
repeated rows lose to their first by the near-duplicates, but for rows of one id and text, of which one
stays; very long texts are taken whole; an empty table gives an empty result; further columns, whatever
their names, pass through all stages, and the mix adds ``repetition`` and ``words``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_documents, op2_decontaminate, op3_simhash, op4_langid, op5_linededup, op6_mix
from tessera.llm.common import WORD_PATTERN, given_folder, remove, table, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model is sure of; those without a letter go."""
    return op4_langid.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; a document that loses all of its words this way goes."""
    out = op5_linededup.judged(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD_PATTERN))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*unpacked(docs.columns, **changed))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return op3_simhash.representatives(docs, near_documents.groups(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return op2_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each whole or partial repetition that a document is taken for."""
    return op6_mix.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
]

#: The network, and the hashes of the near-duplicate stages, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each but the last is written as Parquet and read again, and what only it read is deleted."""
    shared = given_folder(spark) or tempfile.mkdtemp(prefix="tessera-pipeline-")
    docs = table(spark, sf_dir, "documents")
    base = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
