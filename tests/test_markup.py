from tessera.markup import dom, extract, markdown

PAGE = """<!doctype html><html lang="es"><head><title>Site Title</title><style>.a{color:red}</style></head><body>
<header><h1>Site head</h1></header><nav><ul><li>Menu</ul></nav>
<main><h1>Real Heading</h1><p>First <b>paragraph here<p>Second &amp; last.<h2 class="x">Sub Part</h2>
<ul><li>one<li>two <a href="/l">link</a></ul><pre><code class="language-js">let a = 1;
</code></pre><blockquote>said<br>so</blockquote><div class="ad">Buy now</div><script>var x = "</p>";</script></main>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_tree_repairs_left_out_ends():
    root = dom.parse("<ul><li>a<li>b</ul><p>x<p>y<div>z</div>")
    assert [n.tag for n in root.walk()] == ["html", "body", "ul", "li", "li", "p", "p", "div"]
    assert [n.text() for n in dom.select(root, "li, p")] == ["a", "b", "x", "y"]


def test_selectors():
    root = dom.parse('<body><header>h</header><div id=content class="a b"><link rel=stylesheet><link rel=icon><font color=red>f</font></div></body>')
    count = lambda s: len(dom.select(root, s))
    assert [count(s) for s in ("body > header", "#content", ".b", ".ab", 'link:not([rel="stylesheet"])', "font[color]", "font[size]", "div > font, header")] == [1, 1, 1, 0, 1, 1, 0, 2]


def test_selector_extraction():
    out = extract.by_selectors(PAGE)
    for word in ("Real Heading", "First paragraph here", "Second & last.", "Sub Part"):
        assert word in out["text"]
    for word in ("Menu", "Side", "Foot", "Site head", "Buy now", "var x", "color:red"):
        assert word not in out["text"] and word not in out["markdown"]
    assert out["lang"] == "es" and out["title"] is None and out["section_paths"] == ["Real Heading", "Sub Part"]
    md = out["markdown"]
    assert "# Real Heading" in md and "## Sub Part" in md and "```js\nlet a = 1;" in md and "> said" in md and "-   one" in md and "[link](/l)" in md


def test_cascade():
    long = "<p>" + "This paragraph has a good number of words, commas, and some length to it. " * 4 + "</p>"
    good = extract.extract(f"<html><title>T</title><body><nav>{'menu ' * 50}</nav><article><h2>Head</h2>{long * 3}</article></body></html>")
    assert good["method"] == "density" and good["title"] == "T" and "menu" not in good["text"] and good["section_paths"] == ["Head"]
    assert extract.extract(f"<body><div>{'word ' * 40}</div></body>")["method"] == "selectors"
    assert extract.extract("<body><div id=app></div></body>", "clean", "t")["method"] == "raw"
    shown = f"<body><div id=app>{'shown text ' * 60}</div></body>"
    assert extract.extract("<body></body>", "", None, shown)["method"] == "rendered"
    assert extract.extract(None)["text"] == ""


def test_languages_and_structure():
    lang = lambda h: markdown.code_language(dom.select(dom.parse(h), "pre")[0])
    assert [lang(h) for h in ("<pre class=lang-py>x</pre>", "<pre>a =&gt; b</pre>", "<pre>def f():</pre>", "<pre>SELECT 1</pre>", "<pre>&lt;?php</pre>", "<pre>x</pre>")] == ["py", "javascript", "python", "sql", "php", ""]
    assert markdown.structure("") == {"headings": [], "code_blocks": [], "lists": [], "word_count": 1, "character_count": 0}
    info = markdown.structure("# A\n\n- x\n- y\n\n```py\nz\n```\n## B")
    assert [(h["level"], h["text"], h["position"]) for h in info["headings"]] == [(1, "A", 0), (2, "B", 26)]
    assert info["lists"][0]["item_count"] == 2 and info["code_blocks"][0]["language"] == "py"
    assert markdown.tidy("a\n\n\n\n\nb\n# c\n- d\n- e") == "a\n\n\nb\n\n# c\n\n- d\n\n- e"


def test_deep_and_wide_pages():
    for tag in ("span", "b", "div", "p", "li", "blockquote"):
        html = "<body><p>" + f"<{tag}>" * 20_000 + "some words, and more " * 30
        assert "some words" in markdown.to_markdown(dom.parse(html))
        assert "some words" in extract.extract(html)["text"]
    md = markdown.to_markdown(dom.parse("<ol start=3>" + "<li>x" * 20_000 + "</ol>"))
    assert md.startswith("3.  x\n4.  x") and md.endswith("20002.  x")
    found = markdown.structure("# é😀\n\nt\n" * 20_000)["headings"]
    assert len(found) == 20_000 and found[-1]["position"] == 9 * 19_999
    assert extract.extract("<body>" + "<p class=promo>x</p>" * 20_000)["method"] == "raw"


def test_density_reads_like_the_texts():
    root = dom.parse("<body><div> <p> a, b </p><a>link <b>x</b></a>  </div><section><p>c</p></section></body>")
    told = extract._told(root)
    for n in root.walk():
        text, said = n.text(), told[id(n)]
        assert (said.length, said.commas, said.solid) == (len(text), text.count(","), len(text.strip()))
        assert said.linked == sum(len(a.text()) for a in n.walk() if a.tag == "a")
        assert said.holds_scored == any(c.tag in extract._SCORED for c in n.walk())


def test_a_page_that_fails_is_a_row(spark, monkeypatch):
    from tessera.operators import extraction

    def fails(*_):
        raise RecursionError("deep")

    monkeypatch.setattr(extraction.ex, "extract", fails)
    out = extraction._extracted("<p>x", "x", "t", None)
    assert out["method"] == "raw" and out["text"] == "x" and "RecursionError" in out["note"]
    pages = spark.createDataFrame([("u1", "<p>one"), ("u2", None)], "url string, html string")
    assert [(r.url, r.markdown, r.error) for r in extraction.pages_to_markdown(pages).orderBy("url").collect()] == [("u1", "one", None), ("u2", "", None)]
