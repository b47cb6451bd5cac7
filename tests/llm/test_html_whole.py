"""HTML (3): every visible word, by the standard library's parser; broken pages in linear time; tables."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tagflow.llm import html_text

VOID = "area base br col embed hr img input link meta param source track wbr".split()


class Words(HTMLParser):
    """The visible words of a well-formed page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "")
        off = tag in ("head", "script", "style", "title", "template") or "hidden" in a or "display:none" in style
        gone = off or (self.stack[-1][1] if self.stack else False)
        shown = "visibility:visible" in style or ("visibility:hidden" not in style and (self.stack[-1][2] if self.stack else True))
        self.stack.append((tag, gone, shown))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.stack or (not self.stack[-1][1] and self.stack[-1][2]):
            self.words += data.split()


def without_markers(text):
    return Counter(w for w in text.split() if w != "-" and not (w[:-1].isdigit() and w.endswith(".")))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_all_words_of_the_tables_pages(spark, size):
    for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").collect():
        assert without_markers(html_text.page_text(r["html"])) == without_markers(" ".join(Words(r["html"]).words)), r["page_id"]


def page(rng, depth=0):
    word = lambda: f"w{rng.randrange(10**6)}"
    if depth > 5 or rng.random() < 0.2:
        return f" {word()} &amp; {word()} "
    inside = lambda n=3: "".join(page(rng, depth + 1) for _ in range(rng.randint(1, n)))
    kind = rng.choice(["div", "p", "span", "b", "ul", "table", "pre", "section", "hide", "svg", "h2", "dl"])
    if kind == "ul":
        return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{inside()}</li>" for _ in range(3)) + f"</{t}>"
    if kind == "table":
        cell = lambda: f"<td colspan={rng.randint(1, 3)} rowspan='{rng.randint(0, 3)}'>{inside(2)}</td>"
        return "<table>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>" for _ in range(3)) + "</table>"
    if kind == "hide":
        how = rng.choice(["hidden", "style='display: none'", "style='visibility: hidden'", "style='visibility:visible'", 'title="a > b"'])
        return f"<div {how}>{inside()}</div>"
    if kind == "dl":
        return f"<dl><dt>{word()}</dt><dd>{inside()}</dd></dl>"
    return f"<{kind}>{inside() if kind not in ('p', 'pre', 'h2') else word() + ' <i>' + word() + '</i>'}</{kind}>"


def test_all_words_of_random_pages():
    rng = random.Random(11)
    for _ in range(500):
        p = "".join(page(rng) for _ in range(4))
        assert without_markers(html_text.page_text(p)) == without_markers(" ".join(Words(p).words)), p


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>x<td rowspan=2>tall<td>y<tr><td>long<td>z</table>", "x     tall  y\nlong        z"),
        ("<table><tr><th colspan=2>a heading wider<th>n<tr><td>a<td>b<td>c</table>", "a heading wider  n\na  b             c"),
        ("<table><tr><td colspan=900>a<td>b<tr><td>cc<td>d</table>", "a      b\ncc  d"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>xx<td>y</table><td>b</table>", "a  x   y  b\n   xx  y"),
        ("<table><caption>Cap<tr><td>a</table>", "Cap\na"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b></p>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<!-->a<!--->b<!-- x --!>c<!-- to the end", "abc"),
        ("<a title=\"x>one <b>two</b>", "one two"),
        ("a <b", "a <b"),
        ("a <b c", "a <b c"),
        ("<pre>\nx\n  y</pre><textarea>\n z</textarea>", "x\n  y\n\n z"),
        ("<svg><![CDATA[a < b]]></svg> c", "a < b c"),
        ("&#" + "1" * 6000 + "; x", "� x"),
        ("<p>a</br>b", "a\nb"),
        ("<select><optgroup><option>a<option>b<optgroup><option>c</select>", "a\nb\nc"),
    ],
)
def test_forms(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    "part",
    ["<a ", "<a b=\"", "<a b='>\" ", "<a b=\">\" ", "<", "<!", "<!-- ", "</a ", "<a =", "<table>", "<tr>", "<td>", "<td rowspan=2 colspan=1000>x", "<b>x</b> ", "<p>x", "<ul><li>x", "<script>", "<a\t\n  =  ", "&#1", "<div hidden ", "<table><tr>x<b>"],
)
def test_a_megabyte_of_one_broken_form(part):
    whole = part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.page_text(whole[: len(whole) // 2])
    html_text.page_text(whole)
    assert time.process_time() - began < 30


def test_a_wide_cell_pads_no_other_row():
    wide = "x" * 100_000
    got = html_text.page_text(f"<table><tr><td>{wide}<td>b" + "<tr><td>a<td>b" * 2000 + "</table>")
    assert got.startswith(f"{wide}  b\na  b\n") and len(got) < 200_000
