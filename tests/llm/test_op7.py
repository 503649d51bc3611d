import math
import random
import zlib
from collections import Counter

import pytest

from tessera.llm import op7_lm as op

with open(op.MODEL, "rb") as f:
    PROTO = f.read()


def segmentations(text, pieces):
    if not text:
        yield 1.0
    for n in range(1, len(text) + 1):
        p = pieces.get(text[:n])
        if p is not None:
            for rest in segmentations(text[n:], pieces):
                yield p * rest


def ways(text, pieces, byte):
    """(probability, ids) of each segmentation; pieces: text -> (id, probability), byte: the same of each byte."""
    if not text:
        yield 1.0, []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            i, p = pieces[text[:n]]
            for rest, ids in ways(text[n:], pieces, byte):
                yield p * rest, [i, *ids]
    if text and text[0] not in pieces:
        own = [byte[b] for b in text[0].encode()]
        for rest, ids in ways(text[1:], pieces, byte):
            yield math.prod(p for _, p in own) * rest, [*[i for i, _ in own], *ids]


def plain_weights(train, own, ends, rounds):
    """Expectation maximisation by going through all segmentations."""
    weight = own.prior.copy()
    for _ in range(rounds):
        share = weight / weight.sum()
        pieces, byte = {t: (i, share[i]) for i, t in own.text.items()}, {b: (i, share[i]) for b, i in own.byte.items()}
        weight = own.prior.copy()
        for word, n in train.items():
            found = list(ways("▁" + word, pieces, byte))
            total = sum(p for p, _ in found)
            for p, ids in found:
                for i in ids:
                    weight[i] += n * p / total
        weight[own.end] += ends
    return weight


def test_lattice_sums_all_segmentations():
    own = op.Pieces(PROTO)
    lattice = op.Lattice(own, own.prior)
    total = own.prior.sum()
    pieces = {t: own.prior[i] / total for i, t in own.text.items()}
    for word in ("the", "house", "straße", "a", "", "zzz9"):
        want = sum(segmentations("▁" + word, pieces))
        assert lattice.log10(word) == pytest.approx(math.log10(want), abs=1e-9)
    emoji = "\U0001f9ff"
    assert emoji not in pieces
    byte = math.log10(pieces["▁"]) + sum(math.log10(own.prior[own.byte[b]] / total) for b in emoji.encode())
    assert lattice.log10(emoji) == pytest.approx(byte, abs=1e-9)
    assert math.isfinite(lattice.log10("x" * 50_000))


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    vocab = ["the", "The", "river", "éa", "b,", "x1", "longerword"] + [f"rare{i}" for i in range(60)]
    rows = [(i, "  ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\t\n"), (None, "the the unseen"), (3, rows[3][1]), (203, "the " * 20000 + "\U0001f9ff")]
    df = spark.createDataFrame([(a, b, 1, "w") for a, b in rows], "doc_id long, text string, n int, word string")
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    split = [(i, (t or "").lower().split()) for i, t in rows]
    train = Counter(w for i, ws in split if learn(i) for w in ws)
    ends = sum(learn(i) for i, _ in split)
    total, distinct = sum(train.values()) + ends, len(train) + 1
    own = op.Pieces(PROTO)
    weight = plain_weights(train, own, ends, op.ROUNDS)
    lattice = op.Lattice(own, weight)
    want = []
    for i, ws in split:
        c = [train[w] for w in ws] + [ends]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c)
        score = sum(lattice.log10(w) for w in ws) + lattice.end
        want.append((i if i is not None else -1, i is not None and not learn(i), len(c), sum(x > 0 for x in c), total, round(base, 4), round(score, 4)))
    for head in (op.HEAD, 3):
        got = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in op.scores(df, head_words=head).collect()]
        assert sorted(got) == sorted(want)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = op.scores(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, False) and r.base_score == pytest.approx(0) and r.score < 0
    assert op.scores(df.limit(0)).count() == 0


def test_rounds_raise_the_likelihood(spark):
    own = op.Pieces(PROTO)
    train = Counter({"the": 50, "thethe": 3, "rivers": 9, "straße": 4, "\U0001f9ff": 2})
    words = spark.createDataFrame([(w.encode(), n) for w, n in train.items()], "word binary, c long").repartition(3)
    model = spark.sparkContext.broadcast(PROTO)
    seen = []
    for rounds in (0, 1, 2):
        got = op.piece_weights(words, own, model, 7, rounds)
        assert got == pytest.approx(plain_weights(train, own, 7, rounds))
        lattice = op.Lattice(own, got)
        seen.append(sum(n * lattice.log10(w) for w, n in train.items()))
    assert seen[0] < seen[1] < seen[2]
    lattice = op.Lattice(own, own.prior)
    for word in ("thehouse", "straße", "a", "", "rivers,", "q" * 31):
        quick, slow = [0.0] * own.size, [0.0] * own.size
        assert lattice._expect_short("▁" + word, 3.0, quick)
        op.SHORT, kept = 0, op.SHORT
        lattice.expect(word, 3.0, slow)
        op.SHORT = kept
        assert quick == pytest.approx(slow)
    long, uses = "x" * 20_000, [0.0] * own.size
    op.Lattice(own, own.prior).expect(long, 2.0, uses)
    assert sum(n * len(own.text.get(i, "")) for i, n in enumerate(uses)) == pytest.approx(2 * 20_001)
