"""Pages whose text a renderer easily loses, and a second, plain reading of every page of the test tables."""

import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from riskloom.llm import html_text

CASES = [
    # quotes that open no string
    ("<a title=it's href=x>link</a> rest <b>more</b> isn't it", "link rest more isn't it"),
    ('<a "loose>one</a> two "three"', 'one two "three"'),
    ('<a x="a>b" y=\'c>d\'>t</a>', "t"),
    ("<img alt='it is' alt=not><i x= 'a>b'>c</i>", "it isc"),
    ('<p title="never closed>text<p>more', "text\n\nmore"),
    # invisible parents, visible children
    ('<div style="visibility:hidden">no<span style="visibility:visible">yes</span></div>', "yes"),
    ('<div style="display:none">no<span style="visibility:visible">no</span></div>yes', "yes"),
    ('<ul style="visibility:hidden"><li>no<li style="visibility:visible">yes</ul>', "- yes"),
    ('<p style="visibility:hidden">no<b style="visibility:inherit">no</b></p>yes', "yes"),
    ("<style>.h{visibility:hidden}.v{visibility:visible}</style><p class=h>no<i class=v>yes</i><hr></p>", "yes\n\n----"),
    ('<table><tr><td style="visibility:hidden">long text<td>b<tr><td>c<td>d</table>', "   b\nc  d"),
    ("<b>" * 300 + '<i style="visibility:hidden">no<u style="visibility:visible">yes</u></i>' + "</b>" * 300, "yes"),
    # cells over several rows and columns
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=1000>w<td>z<tr><td>a<td>b</table>", "w     z\na  b"),
    (f"<table><tr><td colspan={'9' * 5000} rowspan=²>w</table>", "w"),
    # numbers of lists
    ("<ol><li value=7>x<li>y</ol>", "7. x\n8. y"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"),
    ("<ol type=I><li value=4>x<li value=1999>y<li value=-2>z</ol>", "IV. x\nMCMXCIX. y\n-2. z"),
    ("<ol start=--3><li value=²>x</ol>", "1. x"),
    # labels and empty lines
    ("<form><input type=submit value='Send &amp; go'><input type=hidden value=no><input type=reset value=no hidden></form>", "Send & go"),
    ("a<br><br>b<br>c", "a\n\nb\nc"),
    ("<br><br>a<br><br><br>", "a"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_nothing_visible_is_lost(page, text):
    assert html_text.render(page) == text


class Words(HTMLParser):
    """Text outside elements that show none; an element whose own style or attribute hides it counts to its end tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.said = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in html_text.VOID:
            self.said += [" " + attrs["alt"]] if tag == "img" and attrs.get("alt") and not self.off else []
        elif self.off:
            self.off += [tag] if tag == self.off[0] else []
        elif tag in html_text.UNSEEN or "hidden" in attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
            self.off = [tag]

    def handle_endtag(self, tag):
        if self.off and tag == self.off[0]:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.said.append(data)


def letters(text):
    """What no layout changes: letters, in any order of the cells."""
    return Counter(re.findall(r"[^\W\d_]", text))


def test_second_reading_of_all_pages(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{tiny}/pages.parquet")).collect()}
    for r in rows:
        plain = Words()
        plain.feed(r.html)
        plain.close()
        assert letters(got[r.page_id]) == letters("".join(plain.said)), r.page_id
