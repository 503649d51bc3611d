import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import op8_spotsigs as op

COMMON = set(op.COMMON_WORDS)


def spots(text):
    """The chains as strings; the operator hashes them."""
    words = re.split(r"[\W_]+", text.lower())
    parts, out = [[]], set()
    for w in words:
        if w in COMMON:
            parts.append([])
        parts[-1].append(w)
    if len(parts) == 1:
        return {"\n" + " ".join(words) + " "}
    for p, after in zip(parts[1:], [*parts[2:], []]):
        out.add(" ".join((p + after[1:])[:3]).rstrip(" "))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts():
    rng = random.Random(8)
    vocab = ["house", "river", "Straße", "éléphant", "b4", "green", "stone", "window"] + ["the", "of", "und", "la", "que", "with"] * 2
    out = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 30, 90]))) for _ in range(50)]
    return out + ["", None, "  ", "house", "THE", ". the house.\nof, the river", "😀 the 😀 house", "the of und", out[0], "the " * 20000, "stone " * 20000]


def test_rows_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts())]
    rng.shuffle(rows)
    schema = "doc_id long, text string, part int, sigs string"
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], schema).createOrReplaceTempView("op8_docs")
    for parts in (1, 5, 300):
        got = {r.doc_id: r for r in op.with_next(spark.table("op8_docs"), parts).select("doc_id", "text", "next_text", op.edited(F.col("text"), F.col("next_text")).alias("edited"), op.likeness(F.col("sigs"), F.col("next_sigs")).alias("near")).collect()}
        order = sorted(((d, t or "") for d, t in rows), reverse=True)
        assert len(got) == len(rows)
        for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
            r, k = got[d], len(t) // 3
            assert (r.text, r.next_text, r.edited) == (t, after, t[: len(t) - k] + after[:k])
            assert abs(r.near - jaccard(spots(t), spots(after))) < 1e-9


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    by_text = {}
    for i, t in rows:
        r, t, after = got[i], t or "", (rows[i - 1][1] or "")
        k = len(t) // 3
        new = t[: len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(spots(t)) and len(r.edited_fingerprint) == 8 * len(spots(new))
        assert abs(r.near_edited - jaccard(spots(t), spots(new))) < 1e-9
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_empty_single_and_null_ids(spark):
    df = spark.createDataFrame([(1, "the house")], "doc_id long, text string")
    assert op.with_next(df.limit(0)).count() == 0
    assert op.with_next(df).first().next_text == "the house"
    ties = spark.createDataFrame([(None, "n"), (2, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.next_text) for r in op.with_next(ties, 4).collect())
    assert got == [(0, "n", "b"), (2, "a", "n"), (2, "b", "a"), (2, "b", "b")]


def test_similar_pairs(spark):
    rng = random.Random(10)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 25))) for _ in range(60)]
    for i in range(60):
        s = set(sets[i])
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randrange(60)}
        if s:
            sets.append(sorted(s))
    sets = [list(x) for x in sorted(set(map(tuple, sets)))]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sigs array<int>")
    for least in (0.8, 0.5):
        got = {(r.a, r.b) for r in op.similar_pairs(df, least).collect()}
        assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(set(sets[i]), set(sets[j])) >= least - 1e-9}


def test_similar_documents(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "the house"), (7, "the green stone")]
    rng = random.Random(12)
    for i in range(60):
        ws = " ".join(f"the w{k} v{k}" for k in range(rng.choice([8, 30, 32, 36]))).split()
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = "word%d" % (i % 7)
        rows.append((500 + i, " ".join(ws)))
    sets = [frozenset(spots(t or "")) for _, t in rows]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, id string, links int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.class_id, r.copies, r.links) for r in op.similar_documents(df).collect())
    kinds = set(sets)
    want = []
    for (d, _), s in zip(rows, sets, strict=True):
        ids = [e for (e, _), x in zip(rows, sets, strict=True) if x == s]
        want.append((-1 if d is None else d, min((e for e in ids if e is not None), default=None), len(ids), sum(jaccard(s, x) >= 0.8 - 1e-9 for x in kinds) - 1))
    assert got == sorted(want) and sum(w[3] for w in want) > 20
    assert op.similar_documents(df.limit(0)).count() == 0
