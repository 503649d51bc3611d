import random

import numpy as np
import xxhash

from tessera.llm import golay, op3_simhash
from tessera.llm import op3_simhash as op


def brute(text):
    words = [w for w in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(23)
        y = x
        for b in rng.sample(range(23), rng.randint(0, 2)):
            y ^= 1 << b
        _, kx = golay.keys(np.array([x]))
        _, ky = golay.keys(np.array([y]))
        assert len(kx) in (1, 6) and set(kx.tolist()) & set(ky.tolist())


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["Ünd", "ÉA"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 9, 40, 200])))) for i in range(60)]
    for i in range(60, 110):
        words = rows[rng.randrange(60)][1].split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, (" \n" if i % 2 else "  ").join(words).upper() if i % 3 else " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (5, rows[5][1]), (None, rows[7][1]), (300, "one " * 30000)]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, fp string, node string")
    for most in (48, 1):
        old, op3_simhash.MOST_IN_BUCKET = op3_simhash.MOST_IN_BUCKET, most
        op3_simhash.links.__defaults__ = (most,)
        got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in op3_simhash.groups(df).collect()}
        op3_simhash.MOST_IN_BUCKET, op3_simhash.links.__defaults__ = old, (old,)
        fps = [(i, brute(t)) for i, t in rows]
        comp = list(range(len(fps)))
        changed = True
        while changed:
            changed = False
            for a in range(len(fps)):
                for b in range(len(fps)):
                    if (fps[a][1] ^ fps[b][1]).bit_count() <= 2 and comp[b] < comp[a]:
                        comp[a], changed = comp[b], True
        least = {}
        for (i, _), c in zip(fps, comp):
            if i is not None:
                least[c] = min(i, least.get(c, i))
        assert got == {(i, f): least[c] for (i, f), c in zip(fps, comp)}
    kept = op3_simhash.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_large_ball_without_pairs(spark):
    base = 0x0123456789ABCDEF
    nodes = [(base ^ (1 << i), i) for i in range(64)] + [(base ^ (1 << i) ^ (1 << j), 64 + i * 8 + j) for i in range(8) for j in range(i)]
    nodes = [(f - (1 << 64) if f >> 63 else f, n) for f, n in nodes]
    df = spark.createDataFrame(nodes, "fp long, node long")
    edges = op3_simhash.links(df, 8)
    found = {r.node: r.component for r in op3_simhash.components(edges).collect()}
    assert set(found.values()) == {0} and len(found) == len(nodes)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op3_simhash.groups(df).count() == 0


def test_words_of_long_texts_come_in_parts():
    from tessera.llm.common import word_lists

    rng = random.Random(7)
    for _ in range(500):
        text = bytes(rng.choices(b"ab \n\t\x0b\x0c\rc\xc2\xa0", k=rng.randint(0, 60)))
        assert sum(word_lists(text, rng.randint(1, 9)), []) == text.split()
    words = rng.choices(["one", "two", "three", "four"], k=400_000)  # over one part of a text
    assert op.fingerprint(" ".join(words).encode()) == brute(" ".join(words))
