import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowquarry.llm import catalog, html_text

CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "a  b\n c": "a b c",
    "<h1>T</h1>x<div>y</div>z": "T\n\nx\ny\nz",
    "<b>bold</b>,<i> it</i>": "bold, it",
    "one<br>two<br><br>three": "one\ntwo\n\nthree",
    "<ul><li>a<li>b<ul><li>c</ul></ul>after": "- a\n- b\n  - c\n\nafter",
    "<ol start=3><li>x</li><li>y</ol>": "3. x\n4. y",
    "<table><tr><th>Name<th>N<tr><td>Long name<td>1<tr><td>S<td>22</table>": "Name       N\nLong name  1\nS          22",
    "<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>d</table>": "wide one  c\na  b      d",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><caption>Cap</caption><tbody><tr><td>a<br>b<td>c</table>": "Cap\na  c\nb",
    "<pre>  x\n   y</pre>": "  x\n   y",
    "<div hidden>no</div><p style='display: none'>no</p><p style='VISIBILITY:hidden'>no</p>yes": "yes",
    "<head><title>T</title><style>p{}</style></head><body>b<script>if (a<b) x</script>c": "bc",
    "<p>&amp; &lt;x&gt; &eacute; &#65; &nbsp;end": "& <x> é A \xa0end",
    "<!-- no --><p>a<!-- > b -->c</p>": "ac",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<textarea>a\nb</textarea>": "a\nb",
    "<details><summary>s</summary>inner</details><details open><summary>s</summary>inner</details>": "s\ns\ninner",
    "<div><p>un<b>closed": "unclosed",
    "</p></div>stray</table>": "stray",
    "<p>a</p>\n\n  <p>b</p>": "a\n\nb",
    "<a href='x>y'>link</a>": "link",
    "<select><option>a<option>b</select>": "a\nb",
    "text < 5 and > 3": "text < 5 and > 3",
    "<input type=hidden value=1><noscript>n</noscript><template>t</template>v": "v",
    "": "",
    "<p></p>": "",
}


@pytest.mark.parametrize("html", CASES, ids=range(len(CASES)))
def test_layout(html):
    assert html_text.extract(html) == CASES[html]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td colspan=3 rowspan=9>", "</table>", "<li>", "<ul>", "</ul>", "<script>", "</script>", "<!--", "-->", "<", "a b", "&lt", "<td", '="', "<head>", "<title>", "</title>", "<pre>", "<textarea>", "<svg>", "</svg>", "<br/>", "<body>", "</body>", "</li>", "\x00", "<![CDATA[", "<plaintext>"]), max_size=30))
def test_nothing_fails(parts):
    text = html_text.extract("".join(parts))
    assert text == text.rstrip("\n") and not text.startswith("\n")


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<p>w " * 50_000, "<table>" * 3000 + "x", "<b a" * 50_000, "<!" * 50_000, "'" * 200_000, "<a '" * 20_000])
def test_long_pages(html):
    assert isinstance(html_text.extract(html), str)


def test_all_visible_words_stay():
    words = [f"w{i}" for i in range(500)]
    html = "".join(f"<{t}>{w}</{t}>" for w, t in zip(words, ["p", "b", "div", "span", "li", "td", "h2", "em", "section", "code"] * 50, strict=True))
    found = html_text.extract(html)
    assert all(w in found for w in words)


def test_rows(spark):
    rows = [(1, "u", "<p>a<p>b", "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<b>c</b>", "x"), (1, "u", "<p>a<p>b", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(((r.page_id or 0, r.text, r.n_lines) for r in html_text.page_text(df).collect()))
    assert out == [(0, "c", 1), (1, "a\n\nb", 3), (1, "a\n\nb", 3), (2, "", 0), (3, "", 0)]
    assert html_text.page_text(df.limit(0)).count() == 0


def test_query_reads_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    found = catalog.op10_html_extraction(spark, sf).toPandas()
    assert sorted(found["page_id"]) == sorted(pages["page_id"])
    by_id = dict(zip(found["page_id"], found["text"], strict=True))
    for p in pages.itertuples():
        assert by_id[p.page_id] == html_text.extract(p.html)
        assert "<script" not in by_id[p.page_id]
