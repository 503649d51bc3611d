"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact verification.

Words are lower-cased runs of letters and digits, so case, punctuation and line breaks don't hide a
passage. For an item of n words, each run of n words of a document is a window. Windows and items
have a 64-bit SimHash of their five-word shingles, repeats included. The index over an item size cuts
fingerprints in 4 blocks of 16 bits; two fingerprints within ``RADIUS`` = 19 bits have a block within
4 bits (pigeonhole), and a block's table names, for each of its 65,536 values, all items that near, so
no fingerprint within the radius is lost. At a similarity of 0.8 two SimHashes differ by 9.7 bits on
average with a deviation of 2.9, so the radius is more than three deviations away. Candidates are then
verified exactly: shingles weighted by their counts, sum of minima over sum of maxima, 0.8 or more.

Only windows that hold a shingle of an item of their size are fingerprinted. That loses nothing, as
the similarity of the others is 0. The index is broadcast with the function; it holds at most
``MOST_ITEMS`` items, and larger benchmarks take one pass over the documents for each such part.

Defined cases: null and empty texts hold nothing; items that are null or have fewer than five words
have no shingle and match nothing; equal items are each reported; repeated documents are reported as
often as they occur; empty tables give an empty result; further columns, whatever their names, are
ignored by ``leaks`` and kept by ``clean``. A very long text is searched whole: its word and shingle
hashes are held (8 bytes each), its windows only in pieces of 4,096 places.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, mix64, packed, slices, table, unpacked

SHINGLE, SIMILAR, RADIUS, BLOCKS = 5, 0.8, 19, 4
#: Items that one pass looks for; a pass's index takes about 50 KB an item.
MOST_ITEMS = 2000
_GAP = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: Ranges of other signs than letters and digits beyond ASCII that separate words.
_SIGNS = ((0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x3011), (0xFEFF, 0xFEFF))
_MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SIGNS) + "]")


def normal(text: str | None) -> bytes:
    if not text:
        return b""
    return (text if text.isascii() else _MARKS.sub(" ", text)).lower().encode()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    words = Words(texts, _GAP)
    return words.hashes(False), words.first


def _bits(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle."""
    return np.unpackbits(mix64(shingles).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int32) * 2 - 1


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of shingles[s : s + count] for each s, from running sums."""
    low, high = int(starts.min()), int(starts.max()) + count
    sums = np.zeros((high - low + 1, 64), dtype=np.int32)
    np.cumsum(_bits(shingles[low:high]), axis=0, out=sums[1:])
    at = starts - low
    return np.packbits(sums[at + count] > sums[at], axis=1, bitorder="little").view(np.uint64).ravel()


class SizeIndex:
    """The items of one size: their shingles, fingerprints, and block tables."""

    def __init__(self, ids: list, shingles: np.ndarray):
        self.ids, self.shingles, self.count = ids, shingles, shingles.shape[1]
        self.bags = [Counter(s.tolist()) for s in shingles]
        self.sets = [np.unique(s) for s in shingles]
        zero = np.zeros(1, dtype=np.int64)
        self.prints = np.concatenate([window_fingerprints(s, zero, self.count) for s in shingles])
        width = 64 // BLOCKS
        near = [0]
        for weight in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in bits) for bits in combinations(range(width), weight)]
        masks, self.tables = np.array(near, dtype=np.int64), []
        for b in range(BLOCKS):
            own = (self.prints >> np.uint64(b * width) & np.uint64((1 << width) - 1)).astype(np.int64)
            values = (own[:, None] ^ masks).ravel()
            items = np.repeat(np.arange(len(own), dtype=np.int32), len(masks))
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << width) + 1)).astype(np.int32), items[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, each once."""
        pairs = []
        width = 64 // BLOCKS
        for b, (begin, items) in enumerate(self.tables):
            own = (prints >> np.uint64(b * width) & np.uint64((1 << width) - 1)).astype(np.int64)
            n = begin[own + 1] - begin[own]
            window = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(window))]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            pairs.append(window[close] * len(self.ids) + item[close])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)


def similarity(window: np.ndarray, bag: Counter) -> float:
    """Shared weight over joint weight of two bags of shingles."""
    own = Counter(window.tolist())
    least = sum(min(n, bag[s]) for s, n in own.items())
    most = len(window) + sum(bag.values()) - least
    return least / most


class Index:
    """Everything that a pass looks for: sizes, and which shingles lead to which sizes."""

    def __init__(self, items: list[tuple]):
        by_size: dict[int, list] = {}
        for item_id, text in items:
            words, _ = word_hashes([normal(text)])
            if len(words) >= SHINGLE:
                by_size.setdefault(len(words), []).append((item_id, gram_hashes(words, SHINGLE)))
        self.sizes = {n: SizeIndex([i for i, _ in rows], np.stack([s for _, s in rows])) for n, rows in sorted(by_size.items())}
        pairs = [(s, n) for n, one in self.sizes.items() for s in np.unique(one.shingles).tolist()]
        self.seeds = np.array(sorted({s for s, _ in pairs}), dtype=np.uint64)
        of = {s: i for i, s in enumerate(self.seeds.tolist())}
        self.leads: list[list[int]] = [[] for _ in of]
        for s, n in pairs:
            self.leads[of[s]].append(n)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def search(self, texts: list[str | None]):
        """(text, item id, similarity, first word, words) of the best window of each item in each text."""
        for low, high in slices(texts, 1_000_000):
            words, first = word_hashes([normal(t) for t in texts[low:high]])
            shingles = gram_hashes(words, SHINGLE)
            at = np.flatnonzero(self.maybe[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.seeds, shingles[at]), len(self.seeds) - 1)
            real = self.seeds[place] == shingles[at]
            at, place = at[real], place[real]
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + SHINGLE <= first[text + 1]
            cuts = np.flatnonzero(np.diff(text[inside])) + 1
            for own, seeds in zip(np.split(at[inside], cuts), np.split(place[inside], cuts), strict=True):
                if len(own):
                    t = int(np.searchsorted(first, own[0], side="right")) - 1
                    for found in self._in_text(shingles, int(first[t]), int(first[t + 1]), own, seeds):
                        yield low + t, *found

    def _in_text(self, shingles, begin, end, at, seeds):
        by_size: dict[int, list[int]] = {}
        for p, s in zip(at.tolist(), seeds.tolist(), strict=True):
            for n in self.leads[s]:
                by_size.setdefault(n, []).append(p)
        for n, places in by_size.items():
            if end - begin < n:
                yield from self._whole(self.sizes[n], shingles[begin : end - SHINGLE + 1], end - begin)
                continue
            p = np.array(places)
            edge = np.zeros(end - begin - n + 2, dtype=np.int64)
            np.add.at(edge, np.clip(p - (n - SHINGLE) - begin, 0, len(edge) - 1), 1)
            np.add.at(edge, np.clip(p + 1 - begin, 0, len(edge) - 1), -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0) + begin
            yield from self._of_size(self.sizes[n], n, shingles, begin, starts)

    def _whole(self, one, own, words):
        """Items that a shorter text, as one window, is close to; all that share enough shingles are verified."""
        if len(own) < SIMILAR * one.count:
            return
        shared = np.isin(one.shingles, own).sum(axis=1)  # no similarity is above this share of the item
        for i in np.flatnonzero(shared >= SIMILAR * one.count).tolist():
            got = similarity(own, one.bags[i])
            if got >= SIMILAR:
                yield one.ids[i], got, 0, words

    def _of_size(self, one, n, shingles, begin, starts):
        best: dict[int, tuple[float, int]] = {}
        # pieces of neighbouring starts, so that a text's far ends aren't held together
        for part in np.split(starts, np.flatnonzero(np.diff((starts - begin) >> 12)) + 1):
            window, item = one.candidates(window_fingerprints(shingles, part, one.count))
            for i in np.unique(item).tolist():
                s = part[window[item == i]]
                low = int(s[0])
                held = np.concatenate([[0], np.cumsum(np.isin(shingles[low : int(s[-1]) + one.count], one.sets[i]))])
                most = held[s - low + one.count] - held[s - low]  # no window shares more than this
                bound = most / (2 * one.count - most)
                for k in np.argsort(-bound, kind="stable").tolist():
                    if bound[k] < max(SIMILAR, best.get(i, (0.0, 0))[0] + 1e-12):
                        break
                    got = similarity(shingles[s[k] : s[k] + one.count], one.bags[i])
                    if got >= SIMILAR and got > best.get(i, (0.0, 0))[0]:
                        best[i] = got, int(s[k]) - begin
        for i, (got, place) in best.items():
            yield one.ids[i], got, place, n


def leaks(documents: DataFrame, benchmark: DataFrame, most_items: int = MOST_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): the best window of each item in each document that holds it."""
    spark = documents.sparkSession
    kinds = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, words long"
    items = benchmark.select("item_id", "text").filter("text is not null")
    parts = max(1, -(-items.count() // most_items))
    out = None
    for k in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows.collect()]))

        def run(batches, index=index):
            look = index.value
            for b in batches:
                texts = b.column("text").to_pylist()
                found = list(look.search(texts)) if look.sizes else []
                ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                columns = [pa.array([f[j] for f in found], kind) for j, kind in ((1, None), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                if found:
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "similarity", "first_word", "words"])

        found = documents.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, unchanged, with all their columns; rows of a null id are judged as one."""
    found = leaks(documents, benchmark).select(F.col("doc_id").alias("leaky")).distinct()
    rows = packed(documents, "doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("leaky")), "left_anti")
    return rows.select(*unpacked(documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_SIGNS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _SIGNS) + "]"
ORACLE = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '{_SQL_SIGNS}', ' ', 'g')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '{_SQL_SIGNS}', ' ', 'g')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS s, n FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5)),
b AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, n, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i FROM items WHERE len(ws) >= 5)) GROUP BY ALL),
met AS (SELECT DISTINCT d.doc_id, d.n AS total, d.i, b.item_id, b.n FROM d JOIN b ON d.s = b.s AND d.n >= b.n),
windows AS (SELECT DISTINCT doc_id, item_id, n, w FROM (SELECT doc_id, item_id, n, total, unnest(range(greatest(1, i - n + 5), least(i, total - n + 1) + 1)) AS w FROM met)),
bags AS (SELECT o.doc_id, o.item_id, o.n, o.w, d.s, count(*) AS c FROM windows o JOIN d ON d.doc_id = o.doc_id AND d.i BETWEEN o.w AND o.w + o.n - 5 GROUP BY ALL),
shared AS (SELECT g.doc_id, g.item_id, g.n, g.w, sum(least(g.c, b.c)) AS m FROM bags g JOIN b ON b.item_id = g.item_id AND b.s = g.s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, n, w, m::DOUBLE / (2 * (n - 4) - m)::DOUBLE AS similarity FROM shared)
SELECT doc_id, item_id, similarity, (w - 1)::BIGINT AS first_word, n::BIGINT AS words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, w) AS r FROM scored WHERE similarity >= 0.8) WHERE r = 1
"""
