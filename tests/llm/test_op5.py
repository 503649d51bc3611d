import random

import numpy as np

from tessera.llm import op5_linededup as op
from tessera.llm.common import drop_one_hashes, power_hash


def words(line):
    return line.encode().lower().split()


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < op.LEAST_WORDS - 1 or max(len(a), len(b)) < op.LEAST_WORDS:
        return False
    if len(a) == len(b):
        return len(a) >= op.LEAST_WORDS and sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1 or min(len(a), len(b)) < op.LEAST_WORDS:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    """docs: rows of (id, text) with distinct ids, in order."""
    seen, out = [], {}
    for d, text in docs:
        kept = []
        for line in (text.split("\n") if text is not None else []):
            w = words(line)
            if not w or not any(near(w, s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[d] = None if text is None else "\n".join(kept)
    return out


def test_hash_of_deletions():
    v = np.random.default_rng(0).integers(0, 1 << 63, 40).astype(np.uint64)
    got = drop_one_hashes(v, 5, 25)
    for i in range(20):
        w = np.delete(v[5:25], i)
        assert got[i] == power_hash(w, np.array([0]), np.array([19]))[0]


def test_equal_to_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "b."]
    lines = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 7, 8, 9, 12, 20]))) for _ in range(80)]
    docs = []
    for d in range(70):
        own = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [w[i], rng.choice(vocab)]])
                w = w or ["x"]
            own.append(rng.choice([" ", "  ", "\t"]).join(w) if rng.random() < 0.8 else " ".join(w).upper())
            if rng.random() < 0.2:
                own.append(rng.choice(["", "  "]))
        docs.append((d, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "same " * 5000), (104, "same " * 4999 + "\n" + "b " * 9)]
    docs += [(200 + i, "a template line with one changing word x%d in its middle part" % i) for i in range(40)]
    want = brute(docs)
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, line int, h int").repartition(5)
    got = op.judged(df).collect()
    assert {r.row.doc_id: r.text for r in got} == want
    for r in got:
        total = len(dict(docs)[r.row.doc_id].split("\n")) if dict(docs)[r.row.doc_id] is not None else 0
        assert r.n_lines == total and (r.n_removed == 0 or r.n_removed == total - len(r.text.split("\n")) or not r.text)


def test_ids_null_and_repeated(spark):
    rows = [(None, "one line here"), (5, "one line here\nother"), (5, "one line here\nother"), (6, "other\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.text) for r in op.deduplicated(df).collect())
    assert got == [(-1, "one line here"), (5, "other"), (5, "other"), (6, "new")]
    assert op.deduplicated(df.limit(0)).count() == 0
