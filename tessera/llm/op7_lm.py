"""Language-model scores of documents by subword lattices.

Tokens are words (runs of other bytes than space and 0x09-0x0D, A-Z lower-cased) and one end a
document. Two scores share one pass over the text:

* ``base_score``: add-0.1 unigrams over the training fold's tokens;
* ``score``: a unigram model over the pieces of an existing subword vocabulary. A word's probability
  is the sum over all its segmentations of the products of piece probabilities, by a forward
  recursion in log space over the lattice of pieces; characters that are no piece go by their bytes.
  The vocabulary is used as it is. Its scores are ranks, so the first weight of a piece is one over its
  rank; they weigh all segmentations of all training words, and the expected uses of each piece, on top
  of those first weights (one count a piece on average), are its next weight: ``ROUNDS`` rounds of
  expectation maximisation over the lattice, by the same forward recursion and one back.

Scale: counts of words are gathered by a grouped sum, with partial sums in each task. A lattice is
solved once for each distinct word of the corpus, not for each token. Documents then meet the word
table in two ways: the most frequent words, ``HEAD`` at most, are broadcast; all others are
joined by a shuffle of (row, word, count), so no vocabulary is ever gathered in one place and no word
is dropped. Sums are per input row, so repeated rows each get their scores.

Defined cases: null text is the empty text, of one token; a null id is in no fold, so it is scored as
training text, not held out, but never trained on; an empty table gives an empty result; without
training text all base probabilities are 1 (0.1 over 0.1); very long texts and words are taken whole
(a few numbers a character of one word are held); further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, discard, saved, slices, table, word_lists

FOLDS, HELD_OUT = 10, 0
ALPHA = 0.1
HEAD = 150_000
ROUNDS = 2
#: Characters of a word up to which expected uses are found by plain probabilities, not their logarithms.
SHORT = 32
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words that a task holds before it passes their counts on.
MOST_HELD = 250_000
_LN10 = math.log(10)


class Pieces:
    """A subword vocabulary: its strings, its byte pieces, and prior weights that its scores order."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model)
        t = self.tokenizer
        self.size = t.get_piece_size()
        self.end = t.eos_id()
        self.text = {i: t.id_to_piece(i) for i in range(self.size) if not (t.is_control(i) or t.is_unknown(i) or t.is_byte(i) or t.is_unused(i))}
        self.byte = {int(t.id_to_piece(i)[3:5], 16): i for i in range(self.size) if t.is_byte(i)}
        used = [*self.text, *self.byte.values(), self.end]
        score = np.array([t.get_score(i) for i in used])
        self.prior = np.zeros(self.size)
        self.prior[used] = 1 / (1 + score.max() - score)
        self.prior *= len(used) / self.prior.sum()


class Lattice:
    """Marginal probabilities of words under piece weights."""

    def __init__(self, pieces: Pieces, weight: np.ndarray):
        with np.errstate(divide="ignore"):
            log = np.log(weight / weight.sum())
        self.end = float(log[pieces.end]) / _LN10
        self.bytes = [float(log[pieces.byte[b]]) if b in pieces.byte else -50.0 for b in range(256)]
        self.byte_id = pieces.byte
        self.root: dict = {}
        for i, text in pieces.text.items():
            node = self.root
            for ch in text:
                node = node.setdefault(ch, {})
            node[""] = float(log[i]), i, math.exp(log[i])

    def log10(self, word: str) -> float:
        return self._reach("▁" + word)[-1] / _LN10

    def _reach(self, text: str) -> list:
        n = len(text)
        reach = [None] * (n + 1)  # log probability of all ways to come here
        reach[0] = 0.0
        exp, log1p, root = math.exp, math.log1p, self.root
        for i in range(n):
            here = reach[i]
            if here is None:
                continue
            node, whole = root, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                p = node.get("")
                if p is not None:
                    whole |= j == i
                    new, old = here + p[0], reach[j + 1]
                    if old is None:
                        reach[j + 1] = new
                    else:
                        reach[j + 1] = old + log1p(exp(new - old)) if old > new else new + log1p(exp(old - new))
            if not whole:
                new, old = here + sum(self.bytes[b] for b in text[i].encode()), reach[i + 1]
                reach[i + 1] = new if old is None else max(old, new) + log1p(exp(-abs(old - new)))
        return reach

    def expect(self, word: str, times: float, uses: list) -> None:
        """Adds to ``uses`` how often each piece is expected in ``times`` times the word."""
        text = "▁" + word
        if len(text) <= SHORT and self._expect_short(text, times, uses):
            return
        reach, n, exp, root = self._reach(text), len(text), math.exp, self.root
        through = [0.0] * n + [times]  # how many of the times the segmentation has an edge at each place
        for i in range(n - 1, -1, -1):
            here = reach[i]
            if here is None:
                continue
            node, whole, mass = root, False, 0.0
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                p = node.get("")
                if p is not None:
                    whole |= j == i
                    if through[j + 1]:
                        q = through[j + 1] * exp(here + p[0] - reach[j + 1])
                        mass += q
                        uses[p[1]] += q
            if not whole and through[i + 1]:
                data = text[i].encode()
                q = through[i + 1] * exp(here + sum(self.bytes[b] for b in data) - reach[i + 1])
                mass += q
                for b in data:
                    if b in self.byte_id:
                        uses[self.byte_id[b]] += q
            through[i] = mass


    def _expect_short(self, text: str, times: float, uses: list) -> bool:
        """The same by plain probabilities, which is quicker; False where they are too small for that."""
        n, root = len(text), self.root
        ahead, edges = [1.0] + [0.0] * n, []
        for i in range(n):
            here = ahead[i]
            if not here:
                continue
            node, whole = root, False
            for j in range(i + 1, n + 1):
                node = node.get(text[j - 1])
                if node is None:
                    break
                p = node.get("")
                if p is not None:
                    whole |= j == i + 1
                    ahead[j] += here * p[2]
                    edges.append((i, j, p[2], p[1]))
            if not whole:
                return False
        if ahead[n] < 1e-280:
            return False
        behind = [0.0] * n + [times / ahead[n]]
        for i, j, p, piece in reversed(edges):
            q = p * behind[j]
            behind[i] += q
            uses[piece] += ahead[i] * q
        return True


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, c, a): times of each distinct word in the training fold, and in all documents."""

    def run(batches):
        train: Counter = Counter()
        rest: Counter = Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            out = [pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([train[w] + rest[w] for w in words], pa.int64())]
            train.clear(), rest.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "c", "a"])

        for b in batches:
            for text, learn in zip(b.column("text").to_pylist(), b.column("learn").to_pylist(), strict=True):
                for words in word_lists(text.lower()):
                    (train if learn else rest).update(words)
                    if len(train) + len(rest) >= MOST_HELD:
                        yield flush()
        yield flush()

    rows = documents.filter("text is not null").select(F.col("text").cast("binary").alias("text"), _learns().alias("learn"))
    return rows.mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def _learns():
    return F.coalesce(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))


def piece_weights(words: DataFrame, pieces: Pieces, model, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the pieces after some rounds; the driver gets one number a piece of the vocabulary from each."""
    weight = pieces.prior
    learned = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        given = words.sparkSession.sparkContext.broadcast(weight)

        def run(batches, given=given):
            own = Pieces(model.value)
            lattice, uses = Lattice(own, given.value), [0.0] * own.size
            for b in batches:
                for word, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                    lattice.expect(word.decode(), c, uses)
            total = np.array(uses)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "n"])

        weight = pieces.prior.copy()
        for r in learned.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            weight[r["piece"]] += r["n"]
        weight[pieces.end] += ends
    return weight


def _with_lattice(words: DataFrame, model, weight) -> DataFrame:
    def run(batches):
        lattice = Lattice(Pieces(model.value), weight.value)
        for b in batches:
            found = [lattice.log10(w.decode()) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=["word", "c", "a", "lat"])

    return words.select("word", "c", "a").mapInArrow(run, "word binary, c long, a long, lat double")


def _head_sums(documents: DataFrame, head) -> DataFrame:
    """A row a document: its sums over head words, and its other words with their counts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        place, known, base, lat = head.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for low, high in slices(texts, 8_000_000):
                total, sums, tails = [], [], []
                for text in texts[low:high]:
                    n, own, rest = 0, [0, 0.0, 0.0], Counter()
                    for words in word_lists((text or b"").lower()):
                        at = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                        inside = at[at >= 0]
                        if len(inside) < len(words):
                            rest.update(words[i] for i in np.flatnonzero(at < 0).tolist())
                        n, own = n + len(words), [own[0] + int(known[inside].sum()), own[1] + float(base[inside].sum()), own[2] + float(lat[inside].sum())]
                    total.append(n)
                    sums.append(own)
                    tails.append([{"word": w, "n": n} for w, n in rest.items()])
                columns = [pa.array(total, pa.int64()), *[pa.array([s[k] for s in sums], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], pa.array(tails, tail_type)]
                cut = [b.column(c).slice(low, high - low) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*cut, *columns], names=["doc_id", "held_out", "words", "known", "base", "lat", "tail"])

    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, words long, known long, base double, lat double, tail array<struct<word:binary,n:long>>")


def _frequency():
    """Step of a word's frequency, sixteen to a doubling."""
    return F.floor(F.log2("a") * 16).cast("int")


def _head_level(words: DataFrame, most: int) -> int:
    """The least step so that the words from it on are at most ``most``; from counts of a few hundred steps."""
    held, level = 0, 1 << 20
    for r in words.groupBy(_frequency().alias("f")).count().orderBy(F.desc("f")).collect():
        held += r["count"]
        if held > most:
            break
        level = r["f"]
    return level


def scores(documents: DataFrame, model_path: str = MODEL, head_words: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = documents.sparkSession
    with open(model_path, "rb") as f:  # the driver's file; tasks get its bytes
        proto = f.read()
    model, pieces = spark.sparkContext.broadcast(proto), Pieces(proto)
    counts = saved(word_counts(documents))
    ends = documents.filter(_learns()).count()
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    weight = piece_weights(counts, pieces, model, ends)
    words = saved(_with_lattice(counts, model, spark.sparkContext.broadcast(weight)))
    discard(counts)
    shrink = math.log10(total + ALPHA * (distinct + 1))
    base_of = F.log10(F.col("c") + F.lit(ALPHA)) - F.lit(shrink)

    words = words.select("word", "a", (F.col("c") > 0).cast("long").alias("k"), base_of.alias("b"), "lat")
    level = _head_level(words, head_words)
    top = words.filter(_frequency() >= level).collect()  # at most head_words
    head = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, *[np.array([r[c] for r in top], dtype=t) for c, t in (("k", np.int64), ("b", float), ("lat", float))]))
    rows = saved(_head_sums(documents, head).withColumn("row", F.monotonically_increasing_id()))

    tail = rows.select("row", F.inline("tail")).withColumnRenamed("n", "times")
    met = tail.join(words.filter(_frequency() < level).select("word", "k", "b", "lat"), "word")
    times = F.col("times")
    part = met.groupBy("row").agg(F.sum(times * F.col("k")).alias("known"), F.sum(times * F.col("b")).alias("base"), F.sum(times * F.col("lat")).alias("lat"))
    end_base = math.log10(ends + ALPHA) - shrink
    end_score = Lattice(pieces, weight).end
    own = rows.select("row", "doc_id", "held_out", "words", F.col("known").alias("k0"), F.col("base").alias("b0"), F.col("lat").alias("l0"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return own.join(part, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (plus("k0", "known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (plus("b0", "base") + F.lit(end_base)).alias("base_score"),
        (plus("l0", "lat") + F.lit(end_score)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
