import math
import time

from tessera.functions.hashing import chunk_id_of
from tessera.markup import chunking as ch
from tessera.markup.jsstrings import size

ARTICLE = "# Main\n\nIntro text here.\n\n## One\n\nFirst part. Second part.\n\n### Deep\n\nDeep words.\n\n```js\nlet a = 1;\n\nlet b = 2;\n```\n\n- one\n- two\n\n- three\n\n## Two\n\n> quoted\n> more\n\n| a | b |\n| - | - |\n| 1 | 2 |\nEnd."


def test_blocks():
    got = [(b.kind, b.path, b.splits) for b in ch.blocks(ARTICLE)]
    assert got == [
        ("paragraph", ("Main",), True),
        ("paragraph", ("Main", "One"), True),
        ("paragraph", ("Main", "One", "Deep"), True),
        ("code", ("Main", "One", "Deep"), False),
        ("list", ("Main", "One", "Deep"), False),
        ("blockquote", ("Main", "Two"), False),
        ("table", ("Main", "Two"), False),
        ("paragraph", ("Main", "Two"), True),
    ]
    assert [b.text for b in ch.blocks(ARTICLE)][4] == "- one\n- two\n- three"
    assert all(ARTICLE[b.position :].startswith(b.text.split("\n")[0]) for b in ch.blocks(ARTICLE))


def test_skipped_level_does_not_pad():
    assert [b.path for b in ch.blocks("# A\n### B\nx\n## C\ny")] == [("A", "B"), ("A", "C")]


def test_unclosed_fence_is_a_paragraph():
    text = "# T\nbefore\n```python\nx = 1\n# Not a heading\nlater text"
    got = ch.blocks(text)
    assert [b.kind for b in got] == ["paragraph", "paragraph"] and got[1].splits and "later text" in got[1].text


def test_budget_and_tokens():
    assert ch.budget(512, 15) == 435
    assert ch.tokens("a" * 10, "code") == 4 and ch.tokens("a" * 10) == 3 and ch.tokens("😀") == 1 and size("a😀") == 3


def test_sentences_keep_abbreviations():
    text = "Dr. Smith went to the U.S. Army base. He met e.g. Mr. Jones! Then left"
    assert ch.sentences(text) == ["Dr. Smith went to the U.S. Army base", "He met e.g. Mr. Jones", "Then left"]
    assert ch.sentences("One. Two? Three", compat=False) == ["One.", "Two?", "Three"]


def test_blank_and_plain():
    assert ch.chunk("", "u") == [] and ch.chunk(" \n ", "u") == []
    plain = ch.chunk("Just some plain text.", "u", structured=False)
    assert len(plain) == 1 and plain[0].path == () and plain[0].text == "Just some plain text."


def test_chunks_have_ids_prefix_and_limits():
    text = "# Big\n\n" + "This sentence is one of very many alike. " * 50
    out = ch.chunk(text, "https://x.org/", 50)
    assert len(out) > 1 and all(c.tokens <= 60 + 10 for c in out)
    assert out[0].text.startswith("# Big\n\n") and out[0].id == chunk_id_of("https://x.org/", ["Big"], out[0].text)
    assert [c.id for c in out] == [c.id for c in ch.chunk(text, "https://x.org/", 50)]
    assert all(c.tokens >= math.ceil(size(c.text) / 4) for c in out)


def test_overlap_only_within_a_top_section():
    two = "# A\n\n" + "Alpha words stand here now. " * 12 + "\n\n# B\n\n" + "Beta words stand here too. " * 12
    out = ch.chunk(two, "u", 40)
    first_b = next(c for c in out if c.path == ("B",))
    assert first_b.overlap == 0
    one = "# A\n\n## X\n\nFirst sentence of it. Second sentence of it.\n\n## Y\n\nThird sentence of it. Fourth sentence of it."
    got = ch.chunk(one, "u", 30)
    assert len(got) > 1 and got[1].overlap > 0
    assert ch.chunk(one, "u", 30, 0)[1].overlap == 0


def test_large_document_is_fast():
    begin = time.time()
    out = ch.chunk("# T\n\n" + "A sentence of about forty characters ok. " * 1000, "u")
    assert len(out) > 10 and time.time() - begin < 1
