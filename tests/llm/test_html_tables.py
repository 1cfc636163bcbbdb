"""Tables, visibility and nesting of pages, and the words of all small pages by a second, plain reader."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from adjudica.llm.html_text import HIDDEN, VOID, visible_text


@pytest.mark.parametrize(
    "page, text",
    [
        # Cells are blocks: their headings, paragraphs, lists and preformatted lines stay lines.
        (
            "<table><tr><td><h1>Head</h1><p>a</p></td><td><ul><li>x<li>y</ul><pre>c\n d</pre></table>",
            "Head  - x\n      - y\na\n      c\n       d",
        ),
        ("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>", "A  B  C\n   D  E"),
        ("<table><tr><td>A<td>B<td>C<tr><td colspan=2>F<td>G</table>", "A  B  C\nF     G"),
        ("<table><tr><td colspan=99999999>a<td>b</table>", "a  b"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td>\u6f22\u5b57<td>1<tr><td>abc<td>2</table>", "\u6f22\u5b57  1\nabc   2"),
        ("<table><form><tr><td>a<td>b</form></table>", "a  b"),
        ("<table><tr><td>a<td><table><tr><td>long<td>x<tr><td>y<td>z</table></table>", "a  long  x\n   y     z"),
        ("<table><tr></tr></table>", ""),
        ("<details><summary>S</summary>body</details>", "S"),
        ("<details open><summary>S</summary>body</details>", "S\nbody"),
        ("<div style='visibility:hidden'>x<p style='visibility:visible'>shown</p>y</div>", "shown"),
        ("<div style='visibility:hidden'>x<p>y</p></div>after", "after"),
        ("<div style='display:none'>x<p style='visibility:visible'>y</p></div>after", "after"),
    ],
)
def test_layout(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize("cells", ["<td>", "<td>a<td>"])
def test_tables_in_tables_have_no_depth_limit(cells):
    depth = 3_000
    text = visible_text(f"<table><tr>{cells}" * depth + "x y" + "</table>" * depth)
    assert text.split() == (["a"] * depth if "a" in cells else []) + ["x", "y"]


class Plain(HTMLParser):
    """Text outside elements that never show; closes only what is named, keeps no layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        style = found.get("style") or ""
        unseen = tag in HIDDEN or "hidden" in found or re.search(r"display:\s*none|visibility:\s*hidden", style)
        if tag not in VOID and (self.hidden or unseen):
            self.hidden.append(tag)
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def letters(text: str) -> str:
    """A text without white space and without the marks of list items."""
    return "".join(re.sub(r"(?m)^[^\S\n]*(?:-|\d+\.)[^\S\n]", "", text).split())


def test_the_text_of_all_small_pages():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    assert pages
    for page in pages:
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        expected = "".join("".join(plain.parts).split())
        got = visible_text(page or "")
        # Markers of lists are the extractor's own; cells of one line stand in reading order.
        assert sorted(letters(got)) == sorted(letters(expected)), page
