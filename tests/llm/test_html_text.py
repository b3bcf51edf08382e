import html
import random
import re
from html.parser import HTMLParser

import pytest

from trialmill.llm.html_text import extract, text_of

CASES = {
    "blocks": ("<p>One <b>two</b><p>three<br>four<div>five</div>six", "One two\n\nthree\nfour\n\nfive\nsix"),
    "lists": ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>tail", "- a\n- b\n  1. c\n  2. d\n- e\n\ntail"),
    "list start": ("<ol start=5><li>x</li><li>y</li></ol>", "5. x\n6. y"),
    "table": ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name      | N\nlong name | 1\nx         | 22"),
    "ragged table": ("<table><tbody><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></tbody></table>", "a\nb | c"),
    "hidden": ("<title>t</title><script>var x='</p>';</script><style>.no{display:none}#i,b{visibility:hidden}</style><p hidden>a</p><p style='display: none'>b</p><p class='x no'>c</p><p id=i>d</p><b>e</b><p>seen</p><!-- f -->", "seen"),
    "details": ("<details><summary>sum</summary>inner</details><details open><summary>s</summary>in</details><dialog>x</dialog>", "sum\ns\nin"),
    "pre": ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    "entities": ("a &amp; b &lt;c&gt; &eacute; &#65; &nosuch;", "a & b <c> é A &nosuch;"),
    "white space": ("  a \n\t b  <i> c</i> d ", "a b c d"),
    "stray ends": ("</div>a</p>b</li>", "ab"),
    "unclosed": ("<div><p>a<span>b", "ab"),
    "unclosed comment": ("a<!-- b", "a"),
    "unclosed script": ("a<script>b", "a"),
    "odd brackets": ("1 < 2 and <3 > 2", "1 < 2 and <3 > 2"),
    "quoted bracket": ('<a title="x>y">z</a>', "z"),
    "open quote": ('<a title="x>z</a>', "z"),
    "headings": ("<h1>T</h1>text<h2>U</h2><hr>v", "T\n\ntext\n\nU\n\nv"),
    "head ends at body": ("<head><title>x</title><body>y", "y"),
    "definition list": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\nb\nc\nd"),
    "nested table": ("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>", "a     | d\nb | c"),
    "empty": ("", ""),
}


CASES |= {
    "short comments": ("<!-->visible<p>more</p>", "visible\n\nmore"),
    "shorter comment": ("<!--->a<!---->b<!-- x --!>c<!-- - -- > -->d", "abcd"),
    "item values": ("<ol><li>a<li value=7>b<li>c<li value=x>d</ol><ol reversed><li>a<li>b<li hidden>h<li>c</ol><ol reversed start=9><li>a<li>b</ol>", "1. a\n7. b\n8. c\n9. d\n\n3. a\n2. b\n1. c\n\n9. a\n8. b"),
    "options": ("x<select><option>a<option>b<optgroup><option>c</select>y", "x\na\nb\nc\ny"),
    "foot first": ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</tbody><thead><tr><td>h</thead><caption>cap</caption></table>", "cap\n\nh\nb\nf"),
    "old preformatted": ("<xmp>a  <b>\n c</xmp><listing>d\n  e</listing>f", "a  <b>\n c\n\nd\n  e\n\nf"),
    "nameless ends": ("a</>b</ foo>c</3>d", "abcd"),
    "ruby": ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    page, want = CASES[name]
    assert text_of(page)[0] == want


SHOWN = {
    "print sheet": ("<style>p{margin:0}@media print{.c{display:none}a{x:y}}@media (max-width:9px){.c{display:none}}.d{display:none}</style><p class=c>a</p><p class=d>b</p>", "a"),
    "screen sheet": ("<style>@import 'x';@media screen, print{.c{display:none}}</style><p class=c>a</p><p>b</p>", "b"),
    "later rule": ("<style>.c{display:none}/* .d{display:none} */</style><style>.c{display:block}</style><p class=c>a</p><p class=d>b</p>", "a\n\nb"),
    "cascade": ("<style>#i{display:none}p{display:block}.x{display:none!important}.x{display:block}</style><p id=i>a</p><p class=x>b</p><p>c</p>", "c"),
    "svg": ("a<svg><title>t</title><defs><text>u</text></defs>w<text>one</text><text>two <tspan>three</tspan></text></svg>b<svg><path><p>c", "a one two three b\n\nc"),
    "math": ("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds", "so x=1 holds"),
}


SHOWN |= {
    "no body": ("<head><title>x</title><meta charset=utf-8><p>hello</p>", "hello"),
    "text ends the head": ("<html><head>\n<title>x</title>hello <b>you</b>", "hello you"),
    "head keeps its own": ("<head><noscript><p>n</p></noscript><style>p{display:none}</style><body><p>a</p>b", "b"),
    "list starts": ("<ol start='--5'><li>a</ol><ol start='²'><li>b</ol><ol start='" + "9" * 5000 + "'><li>c</ol><ol start=-2><li>d</ol>", "1. a\n\n1. b\n\n1. c\n\n-2. d"),
    "long references": ("a &#" + "9" * 5000 + "; &#" + "0" * 5000 + "65; &#x" + "f" * 5000 + ";", "a \ufffd A \ufffd"),
    "visible again": ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<i style='visibility:inherit'>d</i></div>", "b"),
    "invisible item": ("<ul><li>a<li style='visibility:hidden'>b<li>c</ul>", "- a\n- c"),
    "hidden in the deep": ("<div>" * 3000 + "a<p hidden>secret</p> b", "a b"),
    "object": ("<object data=x>a</object><object>b</object><canvas>c</canvas>", "b"),
    "first attribute": ("<p class=a hidden=x class=b>a</p>b", "b"),
    "column span": ("<table><tr><th colspan=2>both<th>c<tr><td>a<td>b<td>d<tr><td colspan=3>a rather long line</table>", "both  | c\na | b | d\na rather long line"),
    "row span": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    "odd spans": ("<table><tr><td colspan=0 rowspan=0>a<td colspan=x>b<tr><td colspan=99999999999>c</table>", "a | b\n  | c"),
    "lines in a cell": ("<table><tr><td>a<br>bb<td><ul><li>x<li>y</ul><td>z</table>", "a  | - x | z\nbb | - y"),
    "list around a table": ("<ul><li>a<table><tr><td><ul><li>x</ul><td>y</table><li>b</ul>", "- a\n\n- x | y\n\n- b"),
}


@pytest.mark.parametrize("name", SHOWN)
def test_what_shows_on_a_screen(name):
    page, want = SHOWN[name]
    assert text_of(page)[0] == want


def test_null_and_counts():
    assert text_of(None) == ("", 0, 0, 0)
    assert text_of("<ul><li>a<li>b</ul><table><tr><td>x</table>")[1:] == (4, 2, 1)


def test_deep_nesting_and_long_pages_keep_their_text():
    assert text_of("<div>" * 50000 + "x" + "</div>" * 50000)[0] == "x"
    assert len(text_of("<p>word</p>" * 20000)[0].split()) == 20000
    assert text_of("<" * 20000)[0] == "<" * 20000
    assert text_of("<a " + "x=\"'" * 5000)[0] == ""


def test_column(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", 1), (1, "<p>a</p>", 1), (2, None, None)], "page_id long, html string, text int")
    out = sorted((r[0], r[1]["text"]) for r in df.select("page_id", extract(df["html"])).collect())
    assert out == [(1, "a"), (1, "a"), (2, "")]
    assert df.limit(0).select(extract(df["html"])).count() == 0


class Plain(HTMLParser):
    """Words that show, for pages whose tags all have their ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            style = dict(attrs).get("style") or ""
            self.hidden.append(tag in ("head", "script", "style") or "hidden" in dict(attrs) or "display:none" in style)

    def handle_endtag(self, tag):
        self.hidden.pop()

    def handle_data(self, data):
        if not any(self.hidden):
            self.words += re.findall(r"w[0-9]+", data)


def _page(rng, depth, number):
    """A random part of a page, as whole markup."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "div", "p", "ul", "ol", "table", "b", "hidden", "span"]) if depth else "text"
        inner = lambda: _page(rng, depth - 1, number)
        words = lambda: f" w{next(number)} w{next(number)} "
        if kind == "text":
            out.append(words())
        elif kind == "p":
            out.append(f"<p>{words()}<b>{words()}</b></p>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + f"</{kind}>")
        elif kind == "table":
            out.append("<table><tbody>" + "".join("<tr>" + "".join(f"<td>w{next(number)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</tbody></table>")
        elif kind == "hidden":
            out.append(rng.choice(["<div hidden>{}</div>", "<span style='display:none'>{}</span>", "<script>{}</script>"]).format(words()))
        else:
            out.append(f"<{kind}>{inner()}</{kind}>")
    return "".join(out)


def test_random_pages_against_a_plain_parser():
    rng = random.Random(3)
    for _ in range(300):
        page = "<html><head><title>w0</title></head><body>" + _page(rng, 4, iter(range(1, 10**6))) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        shorter = re.sub("</(?:p|li|td|tr|tbody|body|html|head)>", lambda m: m[0] if rng.random() < 0.5 else "", page)
        for text in (page, re.sub("</(?:li|td|tr|tbody|body|html|head)>", "", page), shorter if "</p>" not in shorter else page):
            assert re.findall(r"w[0-9]+", text_of(text)[0]) == plain.words, text


def test_test_pages_against_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    word = r"[^\W\d_]{2,}"
    for (page,) in rows:
        bare = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<!--.*?-->", "", page)
        bare = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab](?:\s[^>]*)?>", "", bare)))
        assert re.findall(word, text_of(page)[0]) == re.findall(word, bare), page
    assert len(rows) >= 50


def test_many_open_elements_stay_cheap():
    assert text_of("<b>" * 100_000 + "<p>x" * 20_000)[0].count("x") == 20_000
    assert text_of("<table><tr><td colspan=1000 rowspan=9>a" * 300)[0].count("a") == 300


#: Ends whatever may be open in a garbled page.
_CLOSERS = "\"'>'>\">-->" + "".join(f"</{n}>" for n in "script style textarea title xmp iframe noembed noframes template audio video canvas datalist svg math rp annotation head table".split())
_CLOSERS += "".join(f"</{n}>" for n in "table table table rp svg math head td table rp".split())


def test_garbled_pages_keep_what_comes_after():
    """Pages that are cut, with pieces doubled, dropped and swapped: nothing fails, and what follows once all is closed shows."""
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<!--", "-->", "--!>", "<!-->", "<", ">", "</", "</>", "<a href='", '"', "'", "=", "<table>", "<tr>", "<td colspan=9>", "</table>", "<tfoot>", "<thead>", "<li value=3>", "<ol reversed>", "</ol>", "<ul>", "<option>", "<select>", "<xmp>", "</xmp>", "<script>", "</script>", "<style>.a{", "}", "</style>",
              "<textarea>", "</textarea>", "&amp", "&#", "&#x41;", "<svg>", "<text>", "</svg>", "<math>", "<pre>\n", "</pre>", "<!doctype", "<?xml", "word ", "é ", "\n", "<div class=a>", "</div>", "<b", "<br/>", "<title>", "</title>", "<h1>", "<ruby>", "<rp>"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        page = page[rng.randrange(len(page)) // 3 : len(page) - rng.randrange(len(page)) // 3]
        text, lines, items, tables = text_of(page)
        assert lines == (text.count("\n") + 1 if text else 0) and items >= 0 and tables >= 0
        assert "ZEND" in text_of(page + _CLOSERS + "<p>ZEND</p>")[0], page
