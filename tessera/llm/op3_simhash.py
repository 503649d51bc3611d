"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint: words are runs of other bytes than space and 0x09-0x0D, A-Z lower-cased;
each run of three words (all words if fewer), repeats included, is hashed with XXH64 (seed 42), and a
bit is set if it is set in over half of the hashes. Texts without words, and null texts, have 0.

Search: distinct fingerprints only. Their 64 bits are three segments of 23, 23 and 18 bits. Two
fingerprints that differ in at most 2 bits have, by the pigeonhole principle, a segment without an
error, and the segment after it has at most 2, so that its Golay keys meet. A bucket is one exact
segment with one codeword index of the next. Small buckets are verified in place and linked by a
spanning forest, never by all pairs. The members of larger buckets take another exact way: two
fingerprints differ in at most 2 bits if and only if some word is within 1 bit of both, so each one
emits its 65 words within 1 bit, and all that share a word are linked to its least member.

Defined cases: repeated rows are copies of each other; a null id is fingerprinted and takes its
group's smallest id; an empty table gives an empty result; very long texts are hashed whole, in parts;
further columns, whatever their names, are ignored, and kept by ``representatives``.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import checkpoint, components, discard, packed, saved, table, unpacked, word_lists

WORDS, SEED, RADIUS = 3, 42, 2
#: Buckets with more distinct fingerprints than this go the way of shared 1-bit neighbours.
MOST_IN_BUCKET = 48
_SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes | None, size: int = WORDS, seed: int = SEED) -> int:
    """Of one text in UTF-8, as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    count, total, left = np.zeros(64, dtype=np.int64), 0, []
    for words in word_lists((text or b"").lower()):  # a long text in parts of bounded memory
        words = left + words
        left = words[max(0, len(words) - size + 1) :]
        n = len(words) - size + 1
        if n < 1:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        cuts = map(slice, [0, *ends[: n - 1]], (e - 1 for e in ends[size - 1 :]))
        hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), dtype=np.uint64, count=n)
        for i in range(0, n, 50_000):
            count += np.unpackbits(hashes[i : i + 50_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        return xxh64_intdigest(b" ".join(left), seed) if left else 0
    return int(np.packbits(count * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, th, fp): the text's xxhash64 and the fingerprint as signed longs, for every row."""

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t, size, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(values.view(np.int64))], names=["doc_id", "th", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp long")


def _bucket_keys(nodes: DataFrame) -> DataFrame:
    """(bucket, fp, node): for each segment, its bits with each Golay key of the segment after it."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            node = b.column("node").to_numpy(zero_copy_only=False)
            parts = [(fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
            for s in range(3):
                at, index = golay.keys(parts[(s + 1) % 3])
                bucket = (s << 36) | parts[s][at] << 12 | index
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fp[at]), pa.array(node[at])], names=["bucket", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(run, "bucket long, fp long, node long")


def _forests(buckets: DataFrame) -> DataFrame:
    """Edges of a spanning forest within each bounded bucket (lists fps, nodes), of the pairs that are near."""

    def run(batches):
        for b in batches:
            us, vs = [], []
            for fps, nodes in zip(b.column("fps").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                x = np.array(fps, dtype=np.int64).view(np.uint64)
                near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS, 1))
                parent = list(range(len(nodes)))

                def root(i, parent=parent):
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for i, j in near.tolist():
                    if (ri := root(i)) != (rj := root(j)):
                        parent[rj] = ri
                        us.append(nodes[i])
                        vs.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return buckets.mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """Edges (u, v) between ``nodes`` (fp, node: one row a fingerprint) that connect all within 2 bits."""
    # key tables are written before they are joined: straight from their exchange, Spark splits those of hot keys
    keys = saved(_bucket_keys(nodes.filter("node is not null")))
    shared = saved(keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = saved(keys.join(shared, "bucket"))
    discard(keys)
    small = members.filter(F.col("n") <= most_in_bucket).groupBy("bucket").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
    edges = _forests(small.select(F.col("m.fp").alias("fps"), F.col("m.node").alias("nodes")))
    large = members.filter(F.col("n") > most_in_bucket).select("fp", "node").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    variants = saved(large.select("node", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("near")))
    least = saved(variants.groupBy("near").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    stars = variants.join(least, "near").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return edges.unionByName(stars.filter("u <> v").distinct())


def groups(documents: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row; copies meet before the search, and only once."""
    fps = checkpoint(fingerprints(documents, size, seed))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")))
    found = components(links(nodes))
    named = nodes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("of")).select("doc_id", "th", "fp", "component_id")


def representatives(documents: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns as they are.

    ``grouped`` (doc_id, th, component_id) are other groups than those of this query's rule. A row that is
    repeated stays once. Where all ids of a group are null, one row of each text stays.
    """
    found = (groups(documents) if grouped is None else grouped).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = saved(found.groupBy(F.col("doc_id").alias("of"), "th").agg(F.count("*").alias("n")))
    rows = packed(documents, "doc_id").withColumn("tx", F.xxhash64("row.text"))
    once, often = found.filter("n = 1"), found.filter("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tx") == F.col("th"))
    out = rows.join(once, same, "left_semi")
    if not often.isEmpty():
        out = out.unionByName(rows.join(often, same, "left_semi").dropDuplicates(["doc_id", "tx"]))
    return out.select(*unpacked(documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    df = groups(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
