from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import op6_mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert 4 <= len(cp.STAGES) <= 5
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF).cache()
        n = out.count()
        if k + 1 < len(cp.STAGES):
            assert out.columns == names and 0 < n <= docs.count()
            assert out.select("doc_id").distinct().count() == n
        docs = out if k + 1 < len(cp.STAGES) else docs
    mixed = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    plan = {r.doc_id: r.taken for r in op6_mix.plan(docs).filter("taken > 0").collect()}
    assert mixed == plan
    words = out.select(op6_mix.word_count(F.col("text")).alias("a"), F.col("words").alias("b"))
    assert words.filter("a <> b").count() == 0


def test_run_and_empty(spark):
    assert cp.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def _plain_run(docs, items):
    """All stages in plain Python, from rows (doc_id, text, lang, source, n_chars)."""
    from test_op2 import brute as leaks
    from test_near_documents import shingles
    from test_op5 import brute as line_dedup
    from test_op6 import count, water

    from tessera.llm import op4_langid

    langs, weights = _MODEL
    prob = op4_langid.document_probabilities([(t or "").encode() for _, t, *_ in docs], weights)
    docs = [r for r, p in zip(docs, prob, strict=True) if op4_langid.has_letter(r[1]) and p.max() >= op4_langid.LEAST_SCORE]
    kept = line_dedup([(r[0], r[1]) for r in docs])
    docs = [(r[0], kept[r[0]], r[2], r[3]) for r in docs if kept[r[0]] == r[1] or count(kept[r[0]])]
    sets = [(r[0], shingles(r[1])) for r in docs]
    near = {d: [e for e, b in sets if 9 * len(a & b) >= 4 * (len(a) + len(b))] for d, a in sets}
    group = {d: d for d, _ in sets}
    for _ in range(len(docs)):
        new = {d: min(group[e] for e in near[d]) for d, _ in sets}
        if new == group:
            break
        group = new
    docs = [r for r in docs if group[r[0]] == r[0]]
    bad = {d for d, _ in leaks([(r[0], r[1]) for r in docs], items)}
    docs = [r for r in docs if r[0] not in bad]
    sizes: dict = {}
    for r in docs:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    goal = water(sizes)
    return {r[0]: (r[1], goal[r[3]] / sizes[r[3]] * count(r[1])) for r in docs}


_MODEL = None


def test_run_equals_plain_version(spark):
    global _MODEL
    from tessera.llm import op4_langid

    table = spark.read.parquet(f"{SF}/documents.parquet")
    _MODEL = op4_langid.learn(table)
    docs = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = _plain_run(docs, items)
    out = cp.run(spark, SF).collect()
    sums: dict = {}
    for r in out:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.words
        whole = want[r.doc_id][0]
        assert r.text == whole if r.words == len(whole.split()) else r.words < len(whole.split())
    assert set(sums) <= set(want) and {d for d, (_, n) in want.items() if n >= 1} <= set(sums)
    assert all(abs(sums.get(d, 0) - n) <= 1 for d, (_, n) in want.items())


def test_odd_rows_and_names(spark):
    """Nulls, repeated rows and columns by any name go through every stage."""
    names = ["_tx", "_of", "_th", "_gone", "_n_removed", "n_removed", "_leaky", "leaky", "of", "th", "tx", "spans", "row", "gone", "component_id", "node", "size", "taken", "words", "a b", "c.d"]
    line = "the quick brown fox %d jumps over the lazy dog and runs away from the old house by the river\n"
    rows = [(i, line % (i // 2) + "and then some more words of document %d" % (i // 2), "en", "web") for i in range(12)]
    rows += [(20, None, "en", None), (21, "", None, "web"), (22, "12 34", "en", "web"), (None, "a text of its own without an id", "en", None), rows[3], rows[3], (30, "word " * 60_000, "en", "web")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"{n}!" for n in names]) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{n}` string" for n in names]]))
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns if k + 1 < len(cp.STAGES) else out.columns == [*docs.columns, "repetition", "mix_words"]
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert all(r[n] == f"{n}!" for r in docs.collect() for n in names)
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or k + 1 == len(cp.STAGES)
    left = {r.doc_id for r in docs.collect()}
    assert {None, 0, 2, 4, 6, 8, 10, 30} >= left and 20 not in left and 21 not in left and 22 not in left


def test_each_operator_keeps_columns(spark):
    from tessera.llm import op2_decontaminate, op3_simhash, op4_langid, op5_linededup, op9_substrings

    names = ["_tx", "_of", "_th", "_gone", "_n_removed", "_n_lines", "_leaky", "leaky", "of", "spans", "words", "th", "n", "row"]
    rows = [(i, "one line of some words that is the same in every document\nand line number %d" % i, "en", "web") for i in range(5)]
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], ", ".join(["doc_id long, text string, lang string, source string", *[f"{n} string" for n in names]]))
    items = spark.createDataFrame([(1, "an item of five words or more")], "item_id long, text string")
    for out in (op2_decontaminate.clean(docs, items), op3_simhash.representatives(docs), op4_langid.accepted(docs), op5_linededup.deduplicated(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    got = op9_substrings.deduplicated(docs, keep=tuple(names)).collect()
    assert len(got) == 5 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names if n != "n_words")
