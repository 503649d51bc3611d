import hashlib
import math
import re

import pytest

from tessera.llm import op6_mix as op

SCHEMA = "doc_id long, text string, source string, words string, size int"


def water(sizes, budget=1.5, epochs=2, weights=(5, 2, 1)):
    """Targets by the plain loop: share, clamp, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > epochs * sizes[s]}
        if not above:
            return out | {s: left * w[s] / total for s in open_}
        for s in above:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows():
    out = [(i, "word " * (i % 17), f"s{i % 5}", "x", 1) for i in range(100)]
    out += [(200 + i, " a\tb\n c ", None, "x", 1) for i in range(30)]
    out += [(300, None, "s1", "x", 1), (301, "", "Z", "x", 1), (302, "one " * 5000, "é", "x", 1), (None, "null id", "s0", "x", 1), (5, "word " * 5, "s0", "x", 1)]
    return out


def test_equal_to_brute_force(spark):
    data = rows()
    sizes: dict = {}
    for _, t, s, _, _ in data:
        sizes[s] = sizes.get(s, 0) + count(t)
    goal = water(sizes)
    want = []
    for d, t, s, _, _ in data:
        n = count(t)
        u = int(hashlib.md5(f"{op.SEED}:{'' if d is None else d}".encode()).hexdigest()[:8], 16) / 2**32
        taken = min(math.floor((goal[s] / sizes[s] if sizes[s] else 0) * n + u), 2 * n)
        want.append((d or 0, n, sizes[s], round(goal[s], 6), taken))
    got = [(r.doc_id or 0, r["size"], r.source_size, round(r.target, 6), r.taken) for r in op.plan(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)
    again = op.plan(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in again) == sorted((w[0], w[4]) for w in want)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 5}, {"a": 0}, {"a": 0, "b": 3}, {"z": 7}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op.targets(df).collect()}
    want = water(sizes)
    assert got == pytest.approx({s: want.get(s, 0.0) for s in sizes})
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_join_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted((r.doc_id or 0, r.taken) for r in op.plan(df).collect())
    monkeypatch.setattr(op, "MOST_BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id or 0, r.taken) for r in op.plan(df).collect()) == want


def test_mixed_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = op.mixed(df)
    assert out.columns == [*df.columns, "repetition", "mix_words"]
    texts = {(d or 0): t for d, t, _, _, _ in rows()}
    assert {r.words for r in out.collect()} <= {r.words for r in df.collect()}  # the caller's own column
    out = out.drop("words").withColumnRenamed("mix_words", "words")
    sums: dict = {}
    for r in out.collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id or 0])
        assert count(r.text) == r.words and (r.words < len(own) or r.text == texts[r.doc_id or 0])
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text) in [(own + own)[i : i + r.words] for i in range(len(own))]
        sums[r.doc_id or 0] = sums.get(r.doc_id or 0, 0) + r.words
    plan: dict = {}
    for r in op.plan(df).collect():
        plan[r.doc_id or 0] = plan.get(r.doc_id or 0, 0) + r.taken
    assert sums == {d: n for d, n in plan.items() if n}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.plan(df).count() == 0 and op.mixed(df).count() == 0
