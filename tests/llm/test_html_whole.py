import random
import re
from html import escape

import pytest

from flowquarry.llm import html_text

CASES = {
    "<table><tr><form><td>a<td>b</form></tr></table>": "a  b",
    "<table><tbody><form><tr><td>a</td></tr></form></tbody></table>": "a",
    "<table><tr>text<td>a</table>": "text\na",
    "<table><tr><td>A</td><p>note</p></tr></table>": "note\n\nA",
    "<div style='backface-visibility:hidden'>seen</div><p style='color:red; display:none !important'>no</p>": "seen",
    "<svg><defs><text>no</text></defs><text>drawn</text></svg> <math><mi>x</mi></math>": "drawn x",
}


@pytest.mark.parametrize("html", CASES, ids=range(len(CASES)))
def test_visible_text_stays(html):
    assert html_text.extract(html).replace("\n\n", "\n") == CASES[html].replace("\n\n", "\n")


def test_pages_built_with_their_text():
    """Random pages of paragraphs, lists and tables, whose text is written down beside them."""
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "beta", "日本", "été", "a&b", "x<y", "zwölf"])
    some = lambda n: [word() for _ in range(rng.randrange(1, n))]
    wide = lambda s: sum(2 if c in "日本" else 1 for c in s)
    for _ in range(300):
        html, blocks = [], []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.choice(["p", "ul", "ol", "table", "hidden", "h2"])
            if kind in ("p", "h2"):
                words = some(6)
                html.append(f"<{kind}> " + "  \n".join(escape(w) if rng.random() < 0.7 else f"<b>{escape(w)}</b>" for w in words) + (f"</{kind}>" if kind == "h2" else ""))
                blocks.append([" ".join(words)])
            elif kind in ("ul", "ol"):
                items = [some(4) for _ in range(rng.randrange(1, 4))]
                html.append(f"<{kind}>" + "".join(f"<li>{escape(' '.join(i))}" for i in items) + f"</{kind}>")
                blocks.append([(f"{n}. " if kind == "ol" else "- ") + " ".join(i) for n, i in enumerate(items, 1)])
            elif kind == "table":
                cells = [[" ".join(some(3)) for _ in range(3)] for _ in range(rng.randrange(1, 4))]
                html.append("<table>" + "".join("<tr>" + "".join(f"<td>{escape(c)}" for c in row) for row in cells) + "</table>")
                widths = [max(wide(row[k]) for row in cells) for k in range(3)]
                blocks.append(["  ".join(c + " " * (w - wide(c)) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells])
            else:
                html.append(f"<div style='color:red; display : none'><p>{escape(word())}</div><script>if (a<b) x()</script>")
        assert html_text.extract("<body>" + "".join(html)) == "\n\n".join("\n".join(b) for b in blocks), html


def test_text_of_deep_pages_stays():
    for tag in ("div", "span", "ul><li", "table><tr><td", "blockquote"):
        page = "".join(f"<{tag}>w{i} " for i in range(1500))
        assert html_text.extract(page).split() != [] and {f"w{i}" for i in range(1500)} <= set(re.findall(r"w\d+", html_text.extract(page)))


def test_spans_reach_as_far_as_the_standard_lets_them():
    rows = "<tr><td rowspan=0>a<td>b" + "".join(f"<tr><td>r{i}" for i in range(150))
    lines = html_text.extract(f"<table>{rows}</table>").split("\n")
    assert lines[0] == "a  b" and all(line == f"   r{i}" for i, line in enumerate(lines[1:]))
    assert html_text._span(html_text.Node("td", {"colspan": "2000"}), "colspan") == 1000


def _words(text):
    return "".join(text.split())


def test_wide_cells_do_not_pad_every_row():
    """A very wide cell, or very wide spans, cost their own text and a bounded indent per line."""
    rows = "".join(f"<tr><td>{k}</td><td>b{k}</td></tr>" for k in range(2000))
    text = html_text.extract(f"<table><tr><td>{'x' * 100_000}</td><td>end</td></tr>{rows}</table>")
    assert len(text) < 100_000 + 2002 * (html_text.MAX_INDENT + 20)
    lines = text.splitlines()
    assert lines[0] == "x" * 100_000 + "  end"
    assert all(line.split() == [str(k), f"b{k}"] for k, line in enumerate(lines[1:]))
    assert {line.index("b") for line in lines[1:]} == {html_text.MAX_INDENT}


def test_wide_spans_take_no_room():
    page = "<table>" + "".join(f"<tr><td colspan=1000>{k}</td><td>x</td></tr>" for k in range(1500)) + "</table>"
    lines = html_text.extract(page).splitlines()
    assert lines == [f"{k}".ljust(6) + "x" for k in range(1500)]
    page = "<table><tr>" + "<td colspan=1000 rowspan=3>a</td>" * 1000 + "</tr></table>"
    assert html_text.extract(page).split() == ["a"] * 1000


def test_no_text_is_lost_beyond_the_indent():
    row = "".join(f"<td>{'w' * 30}{k}</td>" for k in range(40))
    text = html_text.extract(f"<table><tr>{row}</tr><tr>{row}</tr><tr><td colspan=39>a</td><td>z</td></tr></table>")
    assert [line.split() for line in text.splitlines()] == [[f"{'w' * 30}{k}" for k in range(40)]] * 2 + [["a", "z"]]
