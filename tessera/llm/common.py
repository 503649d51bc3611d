"""What several operators of this subpackage share: checkpoints, byte-level tokens, hashes, components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space bytes that separate words: space and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: The same rule as a regular expression of Java and of RE2.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, as in tests on
    one machine, a folder of our own is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def given_folder(spark: SparkSession) -> str | None:
    """The session's ``spark.checkpoint.dir``. It may be unset on one machine only."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if not given and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return given


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(given_folder(spark) or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared folder and read again.

    For tables with a row a line or more: columns pack several times smaller than checkpointed rows.
    Shuffle files that only the written plan needed are given back at once, if it took a while: the
    driver's collector would do so some day, and until then they'd add up on the executors' disks.
    """
    spark, begun = df.sparkSession, time.monotonic()
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if time.monotonic() - begun > 1:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once no plan reads it any more."""
    remove(df.sparkSession, df._saved_at)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(documents: DataFrame, *names: str) -> DataFrame:
    """(names, row): some columns, and the whole row as one, so that no name of the caller's clashes with ours."""
    return documents.select(*names, F.struct(*[F.col(quoted(c)) for c in documents.columns]).alias("row"))


def unpacked(columns: list[str], **changed) -> list:
    """The columns of a packed row, by their names and in their order; ``changed`` are others for some of them."""
    return [changed.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in columns]


def ascii_lower(col):
    """A-Z only; other letters keep their case."""
    return F.translate(col, _UPPER, _UPPER.lower())


def bucket_of(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``: the fold of a document (null ids are in no fold)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


# --- bytes to words to hashes, for a whole Arrow batch at a time -----------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte; A-Z have those of a-z in the folded table (row 1)."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    plain = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    folded = plain.copy()
    folded[65:91] = plain[97:123]
    return np.stack([plain, folded])


_BLOCK = 1 << 16


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> np.ndarray:
    """The base's powers from 0 to one block, or those of its inverse."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.ones(_BLOCK, dtype=np.uint64)
    filled = 1
    with np.errstate(over="ignore"):
        while filled < _BLOCK:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
    return out


def _unpowered(places: np.ndarray) -> np.ndarray:
    """The inverse base to the power of each place."""
    low = _powers(True)
    step = pow(pow(_BASE, -1, 1 << 64), _BLOCK, 1 << 64)
    high = np.ones((int(places.max()) >> 16) + 1 if len(places) else 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, len(high)):
            high[i] = high[i - 1] * np.uint64(step)
        return low[places & (_BLOCK - 1)] * high[places >> 16]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a polynomial hash depend on all of its input."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def power_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash (mod 2**64, then mixed) of values[start:end] for every pair; one pass of sums.

    ``table``: the values are bytes and stand for its entries; starts and ends are sorted then, and what is
    held besides them is a block of sums, however long the values are.
    """
    power, total = _powers(False), np.uint64(0)
    sums = np.zeros(len(values) + 1, dtype=np.uint64) if table is None else None
    at = [np.zeros(len(starts), dtype=np.uint64), np.zeros(len(ends), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for low in range(0, len(values), _BLOCK):
            part = values[low : low + _BLOCK] if table is None else table[values[low : low + _BLOCK]]
            own = np.cumsum(part * power[: len(part)]) * np.uint64(pow(_BASE, low, 1 << 64)) + total
            total = own[-1]
            if sums is not None:
                sums[low + 1 : low + 1 + len(part)] = own
                continue
            for places, found in zip((starts, ends), at, strict=True):
                i, j = np.searchsorted(places, (low + 1, low + len(part) + 1))
                found[i:j] = own[places[i:j] - (low + 1)]
        left, right = at if sums is None else (sums[starts], sums[ends])
        return mix64((right - left) * _unpowered(starts) + (ends - starts).astype(np.uint64))


def drop_one_hashes(values: np.ndarray, start: int, end: int) -> np.ndarray:
    """``power_hash`` of values[start:end] without its first, its second, ..., its last value."""
    own = values[start:end]
    with np.errstate(over="ignore"):
        step = np.array([pow(_BASE, low, 1 << 64) for low in range(0, max(len(own), 1), _BLOCK)], dtype=np.uint64)
        power = (step[:, None] * _powers(False)[: min(len(own), _BLOCK)]).ravel()[: len(own)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power)])
        left = sums[:-1] + (sums[-1] - sums[1:]) * _powers(True)[1]
        return mix64(left + np.uint64(len(own) - 1))


class Words:
    """The words of a few texts, as spans of one byte buffer.

    ``buf``: the texts joined by a space; ``start``/``end``: the spans of all words; ``first``: for
    text i its words are first[i]:first[i+1]. ``gap``: which bytes are between words; ``between``, one of them,
    is put between the texts.
    """

    def __init__(self, texts: list[bytes], gap: np.ndarray = _IS_SPACE, between: bytes = b" "):
        self.buf = between.join(texts) + between
        self.data = np.frombuffer(self.buf, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        edges, before = [np.zeros(0, dtype=np.int64)], False
        for low in range(0, len(self.data), _BLOCK):  # the last byte is between words, so that each word ends
            solid = np.concatenate([[before], ~gap[self.data[low : low + _BLOCK]]])
            edges.append(np.flatnonzero(solid[1:] != solid[:-1]) + low)
            before = solid[-1]
        edge = np.concatenate(edges)
        self.start, self.end = edge[0::2].copy(), edge[1::2].copy()
        self.first = np.searchsorted(self.start, at)

    def hashes(self, fold: bool) -> np.ndarray:
        return power_hash(self.data, self.start, self.end, _byte_values()[int(fold)])

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_STEPS = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (n up to 64); shorter than ``words`` by n - 1."""
    total = max(len(words) - n + 1, 0)
    with np.errstate(over="ignore"):
        out = np.full(total, n, dtype=np.uint64)
        for k in range(n):
            out += words[k : k + total] * _STEPS[k]
    return mix64(out)


_SPACE = re.compile(b"[" + re.escape(SPACES) + b"]")


def word_lists(text: bytes, most: int = 1 << 20):
    """The words of a text, in lists of those of about ``most`` bytes, so that a long text's words aren't held together."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + most) if at + most < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def slices(texts: list, most: int = 4_000_000):
    """Index ranges whose texts have ``most`` bytes together, or one longer text alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


# --- connected components --------------------------------------------------------------------------


#: Edges up to which a task may hold all of a centre's.
MOST_UNSPLIT = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v long).

    Alternates large-star and small-star steps: each is a grouped minimum joined back to the edges,
    so no group is gathered in a task, and the number of rounds grows with the logarithm of the
    longest chain. Each round is checkpointed. Nodes without an edge to another node don't appear.
    """
    edges = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    schema = "node long, component long"
    if edges.isEmpty():
        return edges.sparkSession.createDataFrame([], schema)

    def mark(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = mark(edges)
    for _ in range(most_rounds):
        # a centre of many edges is a hot key: joined with a written table, Spark can split its rows
        kept = saved if seen[0] > MOST_UNSPLIT else lambda df: df
        both = edges.union(edges.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.filter("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
