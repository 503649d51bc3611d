"""Native text functions: token estimates, HTML and CSS cleaning, excerpts, counts.

White space and lengths follow ECMAScript: white space includes no-break spaces and the byte order
mark, and a length counts UTF-16 units. All patterns are spelled so that Java and RE2 agree.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..markup.jsstrings import SPACES

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

#: Characters a token, by block type.
TOKEN_RATIOS = {"code": 2.5, "table": 3.0, "list": 3.5, "paragraph": 4.0, "blockquote": 4.0, "heading": 4.5, "other": 4.0}
DEFAULT_RATIO = 4.0

#: Elements that are cut with their content, and void or unclosed tags that are cut alone,
#: in the order of removal.
CUT_PATTERNS = [
    r"(?is)<style\b.*?</style>",
    r"""(?i)<link[^>]*rel=["']stylesheet["'][^>]*>""",
    r"""(?i)<link[^>]*type=["']text/css["'][^>]*>""",
    r"(?is)<script\b.*?</script>",
    r"(?is)<noscript\b.*?</noscript>",
    r"(?is)<nav\b.*?</nav>",
    r"(?is)<aside\b.*?</aside>",
    r"(?is)<footer\b.*?</footer>",
    r"(?is)<header\b.*?</header>",
    r"(?is)<button\b.*?</button>",
    r"(?i)<input[^>]*>",
    r"(?is)<textarea\b.*?</textarea>",
    r"(?is)<select\b.*?</select>",
    r"(?is)<option\b.*?</option>",
    r"(?is)<video\b.*?</video>",
    r"(?is)<audio\b.*?</audio>",
    r"(?is)<canvas\b.*?</canvas>",
    r"(?is)<svg\b.*?</svg>",
    r"(?i)<img[^>]*>",
    r"(?is)<picture\b.*?</picture>",
    r"(?i)<source[^>]*>",
    r"(?i)<track[^>]*>",
    r"(?i)<embed[^>]*>",
    r"(?is)<object\b.*?</object>",
    r"(?i)<param[^>]*>",
    r"(?is)<iframe\b.*?</iframe>",
    r"(?is)<form\b.*?</form>",
    r"(?is)<head\b.*?</head>",
    r"(?i)<meta[^>]*>",
    r"(?i)<base[^>]*>",
    r"(?is)<template\b.*?</template>",
    r"(?is)<slot\b.*?</slot>",
    r"(?is)<marquee\b.*?</marquee>",
    r"(?i)<frame[^>]*>",
    r"(?is)<frameset\b.*?</frameset>",
    r"(?is)<noframes\b.*?</noframes>",
    r"(?is)<blink\b.*?</blink>",
    r"(?is)<center\b.*?</center>",
    r"(?is)<font[^>]*color[^>]*>.*?</font>",
    r"(?is)<font[^>]*size[^>]*>.*?</font>",
]

#: Style rules that a browser may leave in rendered text, in the order of removal.
CSS_PATTERNS = [
    r":root\s*\{[^}]*\}",
    r"\.[a-zA-Z][\w-]*\s*\{[^}]*\}",
    r"#[a-zA-Z][\w-]*\s*\{[^}]*\}",
    r"[a-zA-Z][\w-]*\s*\{[^}]*\}",
    r"@[a-zA-Z][\w-]*[^;]*;",
    r"--[\w-]+\s*:\s*[^;}]+[;}]",
    r"[\w-]+\s*:\s*[^;}]+[;}]",
    r"display\s*:\s*[-\w]+",
    r"margin\s*:\s*[^;}]+[;}]",
    r"padding\s*:\s*[^;}]+[;}]",
    r"width\s*:\s*[^;}]+[;}]",
    r"height\s*:\s*[^;}]+[;}]",
    r"color\s*:\s*[^;}]+[;}]",
    r"background\s*:\s*[^;}]+[;}]",
    r"font-[\w-]+\s*:\s*[^;}]+[;}]",
    r"flex[^;}]*[;}]",
    r"-ms-[\w-]+\s*:\s*[^;}]+[;}]",
    r"-webkit-[\w-]+\s*:\s*[^;}]+[;}]",
]
CSS_PATTERNS = [p.replace(r"\s", SPACE) for p in CSS_PATTERNS]

#: Markdown structure that a chunk can consist of, in the order of removal.
STRUCTURE_PATTERNS = [r"(?m)^#{1,6}\s+.*", r"(?s)```.*?```", r"`[^`]+`", r"(?m)^[-*+]\s+.*", r"(?m)^>\s+.*", r"(?m)^\|.*\|$", r"(?m)^[-=]{3,}$"]
STRUCTURE_PATTERNS = [p.replace(r"\s", SPACE) for p in STRUCTURE_PATTERNS]
STRUCTURE_SHARE = 0.3


def js_length(text):
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def js_trim(text):
    return F.trim(text, F.lit(SPACES))


def squeeze(text):
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def token_estimate(text, ratio=DEFAULT_RATIO):
    return F.ceil(js_length(text) / F.lit(float(ratio))).cast("int")


def block_token_estimate(text, block_type):
    ratio = F.lit(DEFAULT_RATIO)
    for name, r in TOKEN_RATIOS.items():
        ratio = F.when(block_type == name, F.lit(r)).otherwise(ratio)
    return F.ceil(js_length(text) / ratio).cast("int")


def clean_html(html):
    """Text of a page without a parser: cut, strip tags, squeeze. Entities stay as they are."""
    for pattern in CUT_PATTERNS:
        html = F.regexp_replace(html, pattern, " ")
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def html_title(html):
    """The title if it stands on one line, else null."""
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^\n\r]*?)</title>", 0)
    inner = js_trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^\n\r]*?)</title>", 1))
    return F.when(found != "", inner)


def clean_rendered_css(text):
    for pattern in CSS_PATTERNS:
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def split_camel_case(text):
    return F.regexp_replace(text, "([α-ωa-z0-9])([Α-ΩA-Z])", "$1 $2")


def excerpt(text, size: int):
    """The first ``size`` characters, trimmed, with dots if there are more; null if empty."""
    start = js_trim(F.substring(text, 1, size))
    return F.when(start != "", F.concat(start, F.when(F.length(text) > size, "...").otherwise("")))


def raw_word_count(text):
    """Words that aren't empty: the pieces, without the empty ones that white space at an end makes."""
    bare = js_trim(text)
    return F.when(bare == "", 0).otherwise(split_word_count(bare))


def split_word_count(text):
    """Pieces between runs of white space, empty ones at the ends included: 1 for an empty text."""
    return (F.regexp_count(text, F.lit(f"{SPACE}+")) + 1).cast("int")


def list_item_count(text):
    return F.regexp_count(text, F.lit("(?m)^[*-] ")).cast("int")


def is_structural(text):
    """Whether less than three tenths of a chunk is left without its markdown structure."""
    whole = js_trim(text)
    rest = whole
    for pattern in STRUCTURE_PATTERNS:
        rest = js_trim(F.regexp_replace(rest, pattern, ""))
    return js_length(rest) < js_length(whole) * F.lit(STRUCTURE_SHARE)


def post_process_markdown(text):
    text = F.regexp_replace(text, "\n{4,}", "\n\n\n")
    text = F.regexp_replace(text, "([^\n])\n(#{1,6} )", "$1\n\n$2")
    return js_trim(F.regexp_replace(text, "([^\n])\n([*-] )", "$1\n\n$2"))


def first_sentence(text):
    return F.get(F.split(text, r"(?<=[.!?])\s+"), F.lit(0))


def code_language(css_class, content):
    """Language of a code block: from its class, else by marks in the content, else empty."""
    named = F.regexp_extract(css_class, "(?:language-|lang-|highlight-)([a-zA-Z0-9]+)", 1)
    has = lambda *marks: reduce(or_, [content.contains(m) for m in marks])
    guess = F.when(has("function ", "=>"), "javascript").when(has("def ", "import "), "python").when(has("SELECT ", "FROM "), "sql").when(has("<?php"), "php").otherwise("")
    return F.when(named != "", named).otherwise(guess)
