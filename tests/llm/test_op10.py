import random

import zstandard

from tessera.llm import op10_licenses as op

MIT = op.TEXTS["MIT"]


def test_savings_equal_plain_use_of_the_library():
    scanner = op.Scanner(op.default_templates()[:8])
    for block in ("Released under the MIT License.", MIT, "no such thing"):
        alone, saved = scanner.savings(block)
        assert alone == len(zstandard.ZstdCompressor(level=op.LEVEL, write_content_size=False).compress(block.encode()))
        for (_, text), s in zip(op.default_templates()[:8], saved, strict=True):
            d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out = zstandard.ZstdCompressor(level=op.LEVEL, dict_data=d).compress(block.encode())
            assert zstandard.ZstdDecompressor(dict_data=d).decompress(out) == block.encode()
            assert s == alone - len(zstandard.ZstdCompressor(level=op.LEVEL, dict_data=d, write_content_size=False).compress(block.encode()))


def test_differences():
    assert op.differences("a b c".split(), "x a b c y".split()) == []
    assert op.differences("a b c".split(), "a q c".split()) == ["replace b -> q"]
    assert op.differences("a b c".split(), "a c".split()) == ["delete b -> "]


def test_every_template_finds_itself():
    scanner = op.Scanner(op.default_templates())
    for key, text in op.default_templates():
        got = scanner.judge(text)
        assert got[0] == key and got[3] == 0, (key, text, got)


def test_documents(spark):
    filler = "River stones were green. The window of the house was open; nobody came.\n"
    rows = [
        (1, filler + "Released under the MIT License.\n" + filler),
        (2, filler + "Copyright (c) 2019 Some One\n" + MIT.replace("Software", "Program", 1) + "\n" + filler),
        (3, filler + "You need a licence to drive a car in this country.\n"),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "This work is licensed under the GNU General Public License, version 7."),
        (6, None),
        (7, ""),
        (8, filler * 2000 + "Licensed under CC BY-NC 4.0. " + filler * 5 + "Licensed under the Apache License, Version 2.0.\n"),
        (9, "İ" * 50 + " Licensed under the ISC License."),
        (1, filler + "Released under the MIT License.\n" + filler),
        (None, op.TEXTS["BSD-3-Clause"]),
    ]
    df = spark.createDataFrame([(a, b, "l", 1) for a, b in rows], "doc_id long, text string, license string, block int")
    found = op.scan(df).collect()
    got = sorted((r.doc_id or 0, r.license) for r in found if r.license)
    assert got == [(0, "BSD-3-Clause"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (4, "GPL-3.0"), (8, "Apache-2.0"), (8, "CC-BY-NC-4.0"), (9, "ISC")]
    for r in found:
        text = dict((a, b) for a, b in rows)[r.doc_id]
        assert text[r.start : r.start + r.length] == r.text
    assert [r.edits for r in found if r.doc_id == 2] == [["replace software -> program"]]
    assert {r.doc_id for r in found} == {None, 1, 2, 3, 4, 5, 8, 9}
    assert op.scan(df.limit(0)).count() == 0
    assert {r.license for r in op.scan(df, []).collect()} == {None}


def test_statement_in_a_longer_block():
    text = "Copyright (c) 2019 Some One and all of the friends. Copyright (c) 2020 Other People of the Project.\nReleased under the MIT License.\n"
    text += "There is no warranty for this program, to the extent permitted by applicable law, and all of the risk is with you and nobody else."
    scanner = op.Scanner(op.default_templates())
    assert len(op.blocks(text)) == 1
    alone, saved = scanner.savings(text)
    assert max(saved) / alone < 0.2
    assert [r[2] for r in scanner.scan(text)] == ["MIT"]


def test_every_template_is_found_in_a_text(spark):
    filler = "River stones were green. The window of the house was open; nobody came.\n"
    rows = [(i, filler * 3 + text + "\n" + filler * 3) for i, (_, text) in enumerate(op.default_templates())]
    found = op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.differing_words) for r in found) == [(i, key, 0) for i, (key, _) in enumerate(op.default_templates())]


def test_all_licenses_of_a_block():
    scanner = op.Scanner(op.default_templates())
    text = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n"
    assert sorted(r[2] for r in scanner.scan(text)) == ["Apache-2.0", "MIT"]
    text = MIT + "\n" + op.TEXTS["GPL-3.0"].replace("hope", "wish") + "\nReleased under the CC0 1.0."
    got = [r[2] for r in scanner.scan(text)]
    assert len(op.blocks(text)) == 1 and sorted(got) == ["CC0-1.0", "GPL-3.0", "MIT"]
    twice = "Released under the MIT License. Some words.\nReleased under the MIT License."
    assert [r[2] for r in scanner.scan(twice)] == ["MIT", "MIT"]


def exact_licenses(text):
    """Every exact occurrence of a template's words anywhere in a text, the longest first, without overlaps: no blocks, no compression."""
    words = [w.lower() for w in op._WORD.findall(text)]
    found = []
    for key, template in op.default_templates():
        own = op._WORD.findall(template.lower())
        found += [(-len(own), i, key) for i in range(len(words) - len(own) + 1) if words[i] == own[0] and words[i : i + len(own)] == own]
    taken, out = set(), []
    for n, i, key in sorted(found):
        if not taken & set(range(i, i - n)):
            taken |= set(range(i, i - n))
            out.append(key)
    return sorted(out)


def test_equal_to_brute_force_over_whole_texts(spark):
    """Neither the cues nor the savings lose an exact license of the table, nor make one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(4)
    templates = op.default_templates()
    filler = "The copyright of stones, warranty of rivers and public domain of the window. Nobody came; licenses were free.".split(" ")
    for i in range(150):  # licenses next to each other, within lines, in other words, doubled
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(templates)[1] if rng.random() < 0.7 else " ".join(rng.choices(filler, k=rng.randint(0, 60))))
        rows.append((10_000 + i, rng.choice(["\n", " ", "\n\n", ". "]).join(parts)))
    got: dict = {}
    for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).filter("license is not null and differing_words = 0").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    want = {d: found for d, t in rows if (found := exact_licenses(t))}
    assert len(want) > 160 and {d: sorted(x) for d, x in got.items()} == want
