"""HTML (3): forms whose visible text must not be lost."""

import pytest

from tagflow.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr>loose text<td>a<td>b</table>", "loose text\na  b"),
        ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
        ("<table><tr><b>x</b> y<td>a</table>", "x y\na"),
        ("<table><tr><form>label<td>A</form><td>B</table>", "label\nA  B"),
        ("<table><tr><div>alone</div></table>", "alone"),
        ("<table><tr><td>a<table><tr><td>b</table></table>", "a\n\nb"),
        ("a <svg><title>no</title><text>drawn</text></svg> b", "a drawn b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
        ("<a href=/it's>don't <b>x</b> it's", "don't x it's"),
        ("<a b'c>one</a> 'two'", "one 'two'"),
        ('<p class=a"b>one</p>"two"', 'one\n\n"two"'),
        ("<a title='x > y'>one</a>", "one"),
        ('<a title = "x > y" b>one</a>', "one"),
        ("<a title=x'y>one</a>", "one"),
        ("<a href=/x?a=\"b\">one</a> two", "one two"),
        ("<a href=>one</a>", "one"),
        ("<br/>a<img src=x/>b", "a b".replace(" ", "")),
        ("<p hidden=''>no</p><p style=display:none>no</p>b", "b"),
    ],
)
def test_visible_text_stays(page, text):
    assert html_text.page_text(page) == text


def test_many_equals_signs_take_linear_time():
    assert html_text.page_text("<a " + "=" * 50_000 + "x").startswith("<a =")
    assert html_text.page_text("<a " + "b= " * 50_000).startswith("<a b=")
