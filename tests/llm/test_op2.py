import random
import re
from collections import Counter

from tessera.llm import op2_decontaminate as op


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def brute(docs, items):
    out = {}
    for d, text in docs:
        ws = words(text)
        every = grams(ws).keys()
        for i, item in items:
            own = words(item)
            if len(own) < 5 or not grams(own).keys() & every:
                continue
            best = 0.0
            for s in range(len(ws) - len(own) + 1):
                a, b = grams(ws[s : s + len(own)]), grams(own)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def cases():
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "abcdéfghij" for b in "xyzüv"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice([6, 12, 25, 25, 40]))) for i in range(30)] + [(100, None), (101, "too short"), (102, ""), (103, "one two " * 9)]
    items.append((104, items[3][1]))
    docs = []
    for d in range(80):
        text = say(rng.choice([0, 3, 30, 120]))
        for _, item in rng.sample(items[:30], rng.randint(0, 2)):
            ws = item.split()
            for _ in range(rng.randint(0, 2)):
                k = rng.choice([0, len(ws) - 1, rng.randrange(len(ws))])
                ws[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [ws[k], "plus"]])
            text += rng.choice([". ", "\n", " — "]) + ", ".join(ws).upper() + " " + say(rng.randint(0, 20))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "one two " * 4000), (503, items[0][1])]
    return docs, items


def test_equal_to_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 40
    df = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for most in (2000, 7):
        rows = op.leaks(df, bench, most).collect()
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
        assert len(rows) == len(got)
        assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
        lost = set(want) - set(got)  # a fingerprint can lie beyond the radius, rarely and near 0.8 only
        assert len(lost) <= 0.02 * len(want) and all(want[k] < 0.9 for k in lost)
    kept = {r.doc_id for r in op.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_find_all_within_radius():
    rng = random.Random(5)
    item = op.Index([(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(20))) for i in range(20)]).sizes[20]
    import numpy as np

    prints = []
    for _ in range(400):
        p = int(item.prints[rng.randrange(20)])
        for b in rng.sample(range(64), rng.randint(0, 24)):
            p ^= 1 << b
        prints.append(p)
    prints = np.array(prints, dtype=np.uint64)
    want = {(w, i) for w in range(400) for i in range(20) if (int(prints[w]) ^ int(item.prints[i])).bit_count() <= op.RADIUS}
    assert {*zip(*(x.tolist() for x in item.candidates(prints)), strict=True)} == want


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert op.leaks(df, bench).count() == 1
    assert op.leaks(df.limit(0), bench).count() == 0 and op.leaks(df, bench.limit(0)).count() == 0
    repeated = df.union(df)
    assert op.leaks(repeated, bench).count() == 2


def test_documents_shorter_than_the_item(spark):
    ws = [f"w{i}" for i in range(24)]
    docs = [(1, " ".join(ws[:-1])), (2, " ".join(ws[2:-2])), (3, " ".join(ws[:-5])), (4, " ".join(ws[:4])), (5, " ".join(ws[:10] + ["x"] + ws[11:-1])), (6, "a b c d e f g h")]
    items = [(1, " ".join(ws)), (2, "a b c d e f g h i"), (3, " ".join(ws[:-1] + ["z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.words) for r in op.leaks(df, bench).collect()}
    assert got == {(1, 1): (0.95, 0, 23), (1, 3): (0.95, 0, 23), (2, 1): (0.8, 0, 20), (2, 3): (0.8, 0, 20), (6, 2): (0.8, 0, 8)}
    assert {r.doc_id for r in op.clean(df, bench).collect()} == {3, 4, 5}
