"""Substring dedup: suffix automata over reference shards, matching statistics, maximal spans removed.

A window is ``WINDOW`` = 20 consecutive words of one document. Every word covered by a window whose
word sequence also starts earlier (smaller doc_id, or earlier in the same document) is removed; all
windows are judged on the input.

The whole corpus is the reference here, so a broadcast of its automata would grow with the corpus.
Instead each window is sent to the one shard that can hold its equals. A window's anchor is its run
of five words with the least hash (leftmost on ties); equal windows have equal anchors. Neighbouring
windows with the same anchor travel as one passage of 20 to 35 words, first as hashes only:

1. passages whose anchor occurs once are done; they are most;
2. equal passages meet, by a grouped minimum: all windows of all but the first are repeats;
3. different passages with the same anchor can share windows. Only these are fetched as words and
   dealt to shards by anchor. A shard of bounded size sorts its passages by position, streams each
   through the suffix automaton of the earlier ones for matching statistics (the longest match that
   ends at each word), marks windows with a match of 20 words, and then adds the passage to the
   automaton. Of anchors with more than ``HOT`` passages, such as a common line in many contexts, no
   task holds all: they are dealt by single windows, whose keys tell equal ones, by a grouped minimum;
4. marks go back to every occurrence and make spans of words.

Defined cases: null text has no words; a document of fewer than 20 words keeps all; rows that repeat
an id and a text are one document; of rows with one id and several texts, the hash of the text orders
them; a null id comes before all others; an empty table gives an empty result; further columns,
whatever their names, are ignored by the query and kept by ``deduplicated`` if asked for (not those
of its own four names); a very long text is taken whole (its word and gram hashes are held, 8 bytes each).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, discard, gram_hashes, power_hash, quoted, saved, slices, table

WINDOW, ANCHOR = 20, 5
#: Different passages of one anchor beyond which its windows are dealt one by one.
HOT = 500
#: Words of a shard, after which it is closed at the next anchor.
SHARD_WORDS = 20_000
_PLACE = (1 << 32) - 1


class SuffixAutomaton:
    """Of the sequences added so far; states are numbers, transitions are dictionaries."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for x in sequence:
            step = nexts[last].get(x)
            if step is not None:  # another sequence came this way
                if length[step] == length[last] + 1:
                    last = step
                else:
                    last = self._split(last, step, x)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and x not in nexts[p]:
                nexts[p][x] = new
                p = link[p]
            if p != -1:
                q = nexts[p][x]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, x)
            last = new

    def _split(self, p: int, q: int, x) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nexts[p].get(x) == q:
            nexts[p][x] = new
            p = link[p]
        return new

    def matches(self, sequence) -> list[int]:
        """Length of the longest suffix of each prefix of ``sequence`` that occurs in what was added."""
        nexts, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for x in sequence:
            while state and x not in nexts[state]:
                state = link[state]
                run = length[state]
            to = nexts[state].get(x)
            if to is not None:
                state, run = to, run + 1
            out.append(run)
        return out


def passages(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor word, anchor hash, passage hash) of all passages; windows and words count in ``words``."""
    grams = gram_hashes(words, ANCHOR)
    spread = WINDOW - ANCHOR + 1
    total = len(words) - WINDOW + 1
    empty = np.zeros(0, dtype=np.int64)
    if total < 1:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    least = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < spread:  # running minimum over ``spread`` places by doubling
        step = min(width, spread - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least[:total] & np.uint64(_PLACE)).astype(np.int64)
    window = np.arange(total)
    text = np.searchsorted(first, window, side="right") - 1
    inside = np.flatnonzero(window + WINDOW <= first[text + 1])
    if not len(inside):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    own = anchor[inside]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[inside][1:] != text[inside][:-1])]))
    begin = inside[new]
    count = np.diff(np.append(new, len(inside)))
    own = own[new]
    with np.errstate(over="ignore"):
        content = power_hash(words, begin, begin + count + WINDOW - 1) + (own - begin).astype(np.uint64)
    return text[begin], begin, count, own, grams[own], content


def _slices_of_words(texts, most):
    """Parts of a batch, in bounded memory."""
    for low, high in slices(texts, most):
        yield low, high, Words([t or b"" for t in texts[low:high]])


def occurrences(documents: DataFrame) -> DataFrame:
    """(anchor, passage, pos, start, windows) of every passage; ``documents`` has pos and text."""

    def run(batches):
        for b in batches:
            pos, texts = b.column("pos"), b.column("text").to_pylist()
            for low, _, words in _slices_of_words(texts, 2_000_000):
                text, begin, count, _, anchor, content = passages(words.hashes(False), words.first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pos.take(pa.array(low + text)), pa.array((begin - words.first[text]).astype(np.int32)), pa.array(count.astype(np.int8))], names=["anchor", "passage", "pos", "start", "windows"])

    return documents.select("pos", "text").mapInArrow(run, "anchor long, passage long, pos long, start int, windows byte")


def _fetched(rows: DataFrame) -> DataFrame:
    """(key, hot, anchor, passage, pos, start, offset, words) of the passages ``asked`` for of each text.

    Passages of hot anchors come as the hashes (key) of their single windows, without the words; offset is
    the window's place in its passage. The key of others is their anchor.
    """

    def run(batches):
        for b in batches:
            pos, texts, asked = b.column("pos").to_pylist(), b.column("text").to_pylist(), b.column("asked").to_pylist()
            out: dict[str, list] = {k: [] for k in ("key", "hot", "anchor", "passage", "pos", "start", "offset", "words")}
            for text, p, want in zip(texts, pos, asked, strict=True):
                own = text.split()
                for a in want:
                    parts = [(a["start"] + k, WINDOW, k) for k in range(a["windows"])] if a["hot"] else [(a["start"], WINDOW - 1 + a["windows"], 0)]
                    for start, n, k in parts:
                        words = b" ".join(own[start : start + n])
                        key = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "big", signed=True) if a["hot"] else a["anchor"]
                        for c, v in zip(out, (key, a["hot"], a["anchor"], a["passage"], p, start, k, None if a["hot"] else words), strict=True):
                            out[c].append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.select("pos", "text", "asked").mapInArrow(run, "key long, hot boolean, anchor long, passage long, pos long, start int, offset byte, words binary")


def shard_marks(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(anchor, passage, bits): the windows of each passage that an earlier passage of the shard holds."""
    automaton, out = SuffixAutomaton(), []
    for _, _, anchor, passage, offset, words in sorted(rows, key=lambda r: r[:2]):
        words = words.split(b" ")
        bits = 0
        for end, run in enumerate(automaton.matches(words)):
            if run >= WINDOW:
                bits |= 1 << (offset + end - WINDOW + 1)
        if bits:
            out.append((anchor, passage, bits))
        automaton.add(words)
    return out


def _marks(fetched: DataFrame) -> DataFrame:
    """(anchor, passage, bits), from shards that each hold all passages of some anchors, ``HOT`` of each at most."""

    def run(batches):
        rows, size, key = [], 0, None

        def closed():
            found = shard_marks(rows)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["anchor", "passage", "bits"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "pos", "start", "anchor", "passage", "offset", "words")), strict=True):
                if r[0] != key and size >= SHARD_WORDS:
                    yield closed()
                    rows, size = [], 0
                key = r[0]
                rows.append(r[1:])
                size += WINDOW
        yield closed()

    dealt = fetched.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "pos", "start", "anchor", "passage", "offset", "words").mapInArrow(run, "anchor long, passage long, bits int")


def repeats(documents: DataFrame) -> DataFrame:
    """(pos, start, bits): repeated windows, 16 bits from each start; ``documents`` has pos and text (binary)."""
    every = saved(occurrences(documents))
    # the key tables of both joins are saved first: joined straight from their exchange, hot keys can be split
    again = saved(every.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    met = saved(every.join(again, "anchor", "left_semi"))
    discard(every)
    first = F.min(F.struct("pos", "start")).alias("f")
    kinds = saved(met.groupBy("anchor", "passage", "windows").agg(first, F.count("*").alias("c")).select("anchor", "passage", "windows", "c", "f.pos", "f.start"))
    several = saved(kinds.groupBy("anchor").agg(F.count("*").alias("d")).filter("d > 1").select("anchor", (F.col("d") > HOT).alias("hot")))
    asked = kinds.join(several, "anchor").groupBy("pos").agg(F.collect_list(F.struct("anchor", "passage", "start", "windows", "hot")).alias("asked"))
    texts = documents.select("pos", "text").filter("text is not null")
    fetched = saved(_fetched(texts.join(asked, "pos")))
    # a hot anchor's windows are equal if their keys are: all but the first of each are repeats
    windows = fetched.filter("hot").select("key", "anchor", "passage", "offset", F.struct("pos", "start").alias("place"))
    earliest = saved(windows.groupBy("key").agg(F.min("place").alias("first")))
    late = windows.join(earliest, "key").filter("first < place")
    late = late.select("anchor", "passage", F.call_function("shiftleft", F.lit(1), F.col("offset").cast("int")).alias("bits"))
    found = _marks(fetched.filter("not hot")).unionByName(late)
    marks = saved(found.groupBy("anchor", "passage").agg(F.bit_or("bits").alias("bits")))
    discard(fetched)

    known = kinds.join(marks, ["anchor", "passage"], "left").filter("c > 1 or bits is not null")
    known = saved(known.select("anchor", "passage", F.col("pos").alias("p"), F.col("start").alias("s"), F.coalesce("bits", F.lit(0)).alias("bits")))
    found = met.join(known, ["anchor", "passage"])
    whole = F.call_function("shiftleft", F.lit(1), F.col("windows").cast("int")) - 1
    bits = F.when((F.col("pos") == F.col("p")) & (F.col("start") == F.col("s")), F.col("bits")).otherwise(whole)
    return found.select("pos", "start", bits.alias("bits")).filter("bits <> 0")


def with_position(documents: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``pos``, a long that orders the documents: the id, where each occurs once. Also whether some rows share a pos."""
    ids = documents.groupBy("doc_id").agg(F.count("*").alias("c"))
    odd = ids.filter("c > 1 or doc_id is null").limit(1).collect()
    if not odd and documents.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return documents.withColumn("pos", F.col("doc_id").cast("long")), False
    th = F.xxhash64("text").alias("_th")
    order = saved(documents.select(F.col("doc_id").alias("_id"), th).distinct().orderBy(F.col("_id").asc_nulls_first(), "_th").withColumn("pos", F.monotonically_increasing_id()))
    return documents.join(order, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))).drop("_id", "_th"), True


def kept_words(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """(words, removed, kept words joined by a space) of a text with its repeated windows."""
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    start = np.array([s["start"] for s in spans])
    bits = np.array([s["bits"] for s in spans])
    for k in range(WINDOW - ANCHOR + 1):
        at = start[bits >> k & 1 == 1] + k
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay.tolist()])


def deduplicated(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *keep): every row with the words that stay, joined by a space."""
    kept = {c: f"kept_{i}" for i, c in enumerate(keep)}
    rows, shared = with_position(documents.select("doc_id", F.col("text").cast("binary").alias("text"), *[F.col(quoted(c)).alias(k) for c, k in kept.items()]))
    distinct = rows.select("pos", "text")
    spans = repeats(distinct.dropDuplicates(["pos"]) if shared else distinct).groupBy(F.col("pos").alias("of")).agg(F.collect_list(F.struct("start", "bits")).alias("spans"))

    def run(batches):
        for b in batches:
            found = [kept_words(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            own = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            own[2] = own[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *own, *[b.column(k) for k in kept.values()]], names=["doc_id", "n_words", "n_removed", "kept", *keep])

    joined = rows.join(spans, F.col("pos") == F.col("of"), "left").select("doc_id", "text", "spans", *kept.values())
    kinds = StructType([documents.schema["doc_id"], *StructType.fromDDL("n_words long, n_removed long, kept string"), *[documents.schema[c] for c in keep]])
    return joined.mapInArrow(run, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    df = deduplicated(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM late, range(0, 20) AS t(o)),
each AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.j) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
