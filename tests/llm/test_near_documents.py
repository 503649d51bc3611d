import random

import corpus_pipeline as cp
from tessera.llm import near_documents as nd
from tessera.llm import op3_simhash


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def cases():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 8, 30, 90, 300])))) for i in range(60)]
    for i in range(60, 220):
        ws = rows[rng.randrange(i)][1].split()
        for _ in range(rng.randint(0, max(1, len(ws) // 40))):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice([[rng.choice(vocab)], [ws[k], "plus"], [ws[k]]])
        rows.append((i, " ".join(ws + rng.choices(vocab, k=rng.choice([0, 0, len(ws) // 12])))))
    boiler = " ".join(rng.choices(vocab, k=40))  # shared by many texts that aren't near
    rows += [(300 + i, boiler + " " + " ".join(rng.choices(vocab, k=60))) for i in range(30)]
    return rows + [(400, None), (401, ""), (402, " \t"), (5, rows[5][1])]


def test_groups_equal_brute_force(spark):
    rows = cases()
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    group = [d for d, _ in rows]
    while True:
        old = list(group)
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
        if old == group:
            break
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in nd.groups(df).collect()}
    want = {d: g for (d, _), g in zip(rows, group, strict=True)}
    assert got == want and 60 < len(set(want.values())) < 200
    beyond = [(i, j) for i, j in near if (op3_simhash.fingerprint((rows[i][1] or "").encode()) ^ op3_simhash.fingerprint((rows[j][1] or "").encode())).bit_count() > 2]
    assert len(beyond) > 20  # pairs that a radius of 2 bits doesn't hold
    kept = cp.dedup_documents(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_nothing_that_is_not_near(spark):
    one = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(one)), (2, " ".join(one[:80] + ["x"] * 20)), (None, " ".join(one)), (3, "a b c"), (4, "a b d"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in cp.dedup_documents(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[5]], key=str)


def test_components_of_many_edges(spark, monkeypatch):
    """The way of large tables, which writes what hot centres are joined with, gives the same."""
    from tessera.llm import common

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {n: n for e in edges for n in e}
    for _ in range(100):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    alone = {n for n in parent if not any(n in e and e[0] != e[1] for e in edges)}
    want = {n: p for n, p in parent.items() if n not in alone}
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (200_000, 0):
        monkeypatch.setattr(common, "MOST_UNSPLIT", most)
        assert {r.node: r.component for r in common.components(df).collect()} == want
