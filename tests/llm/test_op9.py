import random
import re

from tessera.llm import op9_substrings as op


def brute(docs):
    """docs: (id, text) with distinct ids, in order."""
    seen, out = set(), {}
    for d, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        out[d] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def corpus(seed=13):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "the", "a"]
    shared = [rng.choices(vocab, k=rng.choice([19, 20, 21, 35, 60, 150])) for _ in range(25)]
    docs = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(shared)) if rng.random() < 0.7 else rng.choices(vocab, k=rng.randint(0, 60))
            if rng.random() < 0.5 and part:
                part[rng.randrange(len(part))] = rng.choice(vocab)
            if rng.random() < 0.3:
                cut = rng.randrange(len(part) + 1)
                part = part[cut:]
            words += part
        docs.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(300, None), (301, ""), (302, "same " * 3000), (303, " x y" * 500), (304, "same " * 25 + "end"), (305, docs[3][1]), (306, " ".join(shared[4] * 3))]
    line = " ".join(f"c{i}" for i in range(12))
    docs += [(400 + i, " ".join([*rng.choices(vocab, k=15), line, *rng.choices(vocab, k=15)])) for i in range(60)]
    return docs


def test_automaton_matching_statistics():
    rng = random.Random(14)
    for _ in range(60):
        auto, texts = op.SuffixAutomaton(), []
        for _ in range(6):
            t = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
            got = auto.matches(t)
            joined = ["".join(x) for x in texts]
            for e in range(len(t)):
                want = max((n for n in range(e + 2) if any("".join(t[e + 1 - n : e + 1]) in x for x in [*joined, ""] if n == 0 or x)), default=0)
                assert got[e] == want
            auto.add(t)
            texts.append(t)


def test_equal_to_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    assert sum(x[1] for x in want.values()) > 2000
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, pos int, start string").repartition(6)
    for hot, shard in ((500, 20_000), (2, 50)):
        op.HOT, op.SHARD_WORDS = hot, shard
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op.deduplicated(df, keep=("pos",)).collect()}
        assert got == want
    op.HOT, op.SHARD_WORDS = 500, 20_000


def test_ids_null_and_repeated(spark):
    text = " ".join(f"v{i}" for i in range(25))
    rows = [(None, text), (5, text + " more"), (5, text + " more"), (7, "tail " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept[:4]) for r in op.deduplicated(df).collect())
    assert got == [(0, 25, 0, "v0 v"), (5, 26, 25, "more"), (5, 26, 25, "more"), (7, 26, 25, "tail")]
    assert op.deduplicated(df.limit(0)).count() == 0
