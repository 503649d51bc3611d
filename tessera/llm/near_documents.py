"""Near-duplicate documents by similarity of their five-word shingles, as the corpus pipeline needs them.

Words are those of op3: runs of other bytes than space and 0x09-0x0D, A-Z lower-cased. A document is
the set of its runs of five words (all its words if fewer; one fixed shingle if it has none), each as
a 64-bit hash. Two documents are near if their sets have a Jaccard similarity of 0.8 or more, and
groups are the connected components of that. Documents with equal sets are one node.

1. Golay search: a node's SimHash is that of its set. Fingerprints within 2 bits meet by op3's keys,
   and what they propose is verified by the whole sets.
2. A SimHash can't promise more: at 0.8 two fingerprints differ by 9.7 of 64 bits on average. So what
   the keys can't reach is found by an exact search. A screen comes first: in one order of all shingles,
   a set of k and a near one share at least ceil(t / 10) of their first ones, t = ceil(0.8 k), if a set
   shows its first k - t + ceil(k / 10). Only sets with so many shared ones go on.
3. Of these, all shingles are counted, and those that are in few sets come first. Two near sets share one
   among the first k - ceil(8 k / 9) + 1 of the smaller and the first k - t + 1 of the larger. For each
   such shingle, every set is compared with the smallest node that has it, which links large groups at
   the cost of a row each; then pairs of different components are met by a join. Shingles that one
   component has alone take no part. Proposed pairs are verified by the whole sets.

Defined cases are those of op3: repeated rows are copies of each other, null ids are grouped too,
null texts are texts without words, very long texts are taken whole (a task holds one text's shingles,
eight bytes a word), and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import op3_simhash
from .common import Words, components, discard, gram_hashes, mix64, saved, slices

WORDS = 5


def shingle_sets(texts: list[bytes | None]):
    """The sorted, distinct shingles of each text, in order."""
    words = Words([t or b"" for t in texts])
    hashes, first = words.hashes(True), words.first
    grams = gram_hashes(hashes, WORDS)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= WORDS:
            yield np.unique(grams[begin : end - WORDS + 1])
        else:
            yield gram_hashes(hashes[begin:end], end - begin) if end > begin else np.zeros(1, dtype=np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """A set's hash, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def shown(k: int) -> int:
    """How many of a set's first shingles the screen looks at."""
    return k - -(-4 * k // 5) + -(-k // 10)


def simhash(shingles: np.ndarray) -> int:
    """64 bits, each one set if it is set in over half of the shingles; as a signed long."""
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), 50_000):  # a long text in parts of bounded memory
        count += np.unpackbits(shingles[i : i + 50_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def _mapped(texts: DataFrame, kept: list[str], schema: str, make) -> DataFrame:
    """Rows of ``make`` (from the sets of a few texts) with the columns ``kept`` of the row that each came from."""

    def run(batches):
        for b in batches:
            every = b.column("text").cast(pa.binary()).to_pylist()
            for low, high in slices(every, 1_000_000):
                at, columns = make(shingle_sets(every[low:high]))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(low + at)) for c in kept], *columns], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return texts.mapInArrow(run, schema)


_NONE = np.zeros(0, dtype=np.int64)


def nodes_of(documents: DataFrame) -> DataFrame:
    """(doc_id, th, node, k, fp) for every row: the text's xxhash64, the set's hash, size and SimHash."""

    def make(sets):
        values = np.array([(node_of(s), len(s), simhash(s)) for s in sets], dtype=np.int64).reshape(-1, 3)
        return np.arange(len(values)), [pa.array(np.ascontiguousarray(c)) for c in values.T]

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return _mapped(texts, ["doc_id", "th"], f"doc_id {kind}, th long, node long, k long, fp long", make)


def _columns(parts: list[tuple[np.ndarray, int, int]]) -> list[pa.Array]:
    """(shingle, node, k) columns of (shingles, node, k) of several sets."""
    n = [len(p[0]) for p in parts]
    out = [np.concatenate([_NONE, *[p[0] for p in parts]]), *[np.repeat(np.array([p[j] for p in parts], dtype=np.int64), n) for j in (1, 2)]]
    return [pa.array(c) for c in out]


def shingle_rows(texts: DataFrame, screen: bool) -> DataFrame:
    """(shingle, node, k): the shingles of each set, or the first ones that the screen looks at."""

    def make(sets):
        return _NONE, _columns([((s[: shown(len(s))] if screen else s).view(np.int64), node_of(s), len(s)) for s in sets])

    return _mapped(texts.select("text"), [], "shingle long, node long, k long", make)


def _texts(documents: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """(text, *more) of the row that stands for each of ``nodes`` (at, *more); a repeated row comes as often as it is there."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    wanted = nodes.select(F.col("at.doc_id").alias("of"), F.col("at.th").alias("tx"), *more)
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("tx"))).select("text", *more)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of 0.8 or more."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(x) + len(y)
                keep.append(9 * (both - len(np.unique(np.concatenate([x, y])))) >= 4 * both)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The near ones of the proposed pairs (u, v)."""

    def make(sets):
        sets = list(sets)
        return _NONE, [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

    pairs = saved(pairs)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    # written first, so that its size is known, and all texts are sent around only where it is large
    chosen = saved(nodes.join(wanted, "node", "left_semi").select("at", "node"))
    sets = saved(_mapped(_texts(documents, chosen, "node").dropDuplicates(["node"]), [], "node long, shingles array<long>", make))
    out = saved(_near(pairs, sets))
    for df in (sets, chosen, pairs):
        discard(df)
    return out


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that connect all nodes with fingerprints within op3's radius."""
    heads = saved(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    return same.union(op3_simhash.links(heads.withColumnRenamed("head", "node")).select("u", "v"))


def _counts(rows: DataFrame) -> DataFrame:
    """(shingle, n) of the shingles that more than one node has; n counts rows."""
    counts = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    return saved(counts.filter("a < b").select("shingle", "n"))


def _screened(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that can be near another."""
    rows = saved(shingle_rows(documents, True))
    counts = _counts(rows)
    shared = rows.join(counts, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    # a node's rows come once for each of its copies
    out = saved(nodes.join(shared, "node").filter("10 * shared >= copies * ((4 * k + 4) div 5)").select(*nodes.columns))
    for df in (rows, counts):
        discard(df)
    return out


def _held(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shingle, node, k, small): the first shingles of the nodes that another may have among its; ``small``: also as the smaller set."""
    screened = _screened(documents, nodes)
    rows = saved(shingle_rows(_texts(documents, screened, "node").dropDuplicates(["node"]), False))
    counts = _counts(rows)
    shared = rows.join(counts, "shingle")
    own = Window.partitionBy("node")
    place = F.col("k") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "shingle"))  # from 1; those that no other has come first
    placed = shared.withColumn("place", place).filter("place <= k - (4 * k + 4) div 5 + 1")
    out = saved(placed.select("shingle", "node", "k", F.expr("place <= k - (8 * k + 8) div 9 + 1").alias("small")))
    for df in (rows, counts, screened):
        discard(df)
    return out


def _in_components(held: DataFrame, linked: DataFrame) -> DataFrame:
    """``held`` with each node's component ``c``, of the shingles that more than one component has."""
    at = saved(held.join(linked, "node", "left").select("shingle", "node", "k", "small", F.coalesce("component", "node").alias("c")))
    mixed = saved(at.groupBy("shingle").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("small").alias("s")).filter("a < b and s").select("shingle"))
    out = saved(at.join(mixed, "shingle", "left_semi"))
    discard(at)
    return out


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, th, component_id) for every row: the smallest id of its group, null if all are null."""
    rows = saved(nodes_of(documents))
    nodes = saved(rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.min("k").alias("k"), F.min("fp").alias("fp"), F.count("*").alias("copies")))
    edges = _verified(documents, nodes, golay_pairs(nodes).distinct())

    held = _held(documents, nodes)
    alike = "5 * ku >= 4 * kv and 5 * kv >= 4 * ku and cu <> cv"
    at = _in_components(held, components(edges))
    u = at.select("shingle", F.col("node").alias("u"), F.col("k").alias("ku"), F.col("c").alias("cu"))
    head = saved(at.groupBy("shingle").agg(F.min(F.struct("node", "k", "c")).alias("h")).select("shingle", F.col("h.node").alias("v"), F.col("h.k").alias("kv"), F.col("h.c").alias("cv")))
    edges = saved(edges.union(_verified(documents, nodes, u.join(head, "shingle").filter(alike).select("u", "v").distinct())))

    at = _in_components(held, components(edges))
    u = at.select("shingle", F.col("node").alias("u"), F.col("k").alias("ku"), F.col("c").alias("cu"))
    v = at.filter("small").select("shingle", F.col("node").alias("v"), F.col("k").alias("kv"), F.col("c").alias("cv"))
    pairs = u.join(v, "shingle").filter(alike + " and (ku > kv or ku = kv and u > v)").select("u", "v").distinct()
    found = components(edges.union(_verified(documents, nodes, pairs)))

    named = rows.join(found, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("c"))
    smallest = saved(named.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    return named.join(smallest, "c").select("doc_id", "th", "component_id")
