import hashlib
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import html

CASES = [
    ("", ""),
    ("plain < text & more &amp; &lt;b&gt;", "plain < text & more & <b>"),
    ("<p>one<p>two\n  <b>bold</b>er", "one\n\ntwo bolder"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>no</title><script>var t='</p>';</script><style>p{}</style>yes<!-- no -->", "yes"),
    ("<head><title>x</title><p>body</p>", "body"),
    ("<ul><li>a<li>b<ol><li>c</li><li>d</ol><li>e</ul>", "- a\n- b\n  1. c\n  2. d\n- e"),
    ("<ol start=3><li>x<li value=7>y<li>z</ol>", "3. x\n7. y\n8. z"),
    ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
    ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>yes", "yes"),
    ("<div><nav>menu</nav>text</div><footer>&copy; me</footer>", "menu\ntext\n© me"),
    ("<h1>T</h1><p>x", "T\n\nx"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
    ("<table><caption>C</caption><thead><tr><th>h<th>i</thead><tbody><tr><td colspan=2>wide cell</tbody></table>", "C\nh | i\nwide cell"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td>x<table><tr><td>in</table><td>y</table>", "x  | y\n\nin"),
    ("<pre>\n  a\n b </pre>", "  a\n b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("</p>x</br>y</div>z", "x\nyz"),
    ("<img alt='pic'> <a href='x'>link</a> a&nbsp;b", "pic link a b"),
    ("<p>漢字</p><table><tr><td>漢字<td>a<tr><td>abcd<td>b</table>", "漢字\n\n漢字 | a\nabcd | b"),
    ("<select><option>no</select><textarea>t &amp; u</textarea>", "t & u"),
    ("<p><b>un<i>closed<p>next", "unclosed\n\nnext"),
    ("x<hr>y", "x\n\n---\n\ny"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_rules(page, text):
    assert html.extract(page) == text


def test_deep_and_long():
    assert html.extract("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html.extract("<table><tr><td>" * 300 + "x").strip() == "x"
    assert html.extract("<p>word " * 20_000).count("word") == 20_000


EVERYTHING = [
    ("<p aria-hidden=true>seen</p>yes", "seen\n\nyes"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<select multiple><option>a<option>b</select>", "a\nb"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<svg><title>no</title><text>label</text></svg>", "label"),
    ("<body hidden><p>no", ""),
    ("<html hidden><p>no", ""),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<button>Go</button><textarea>t</textarea>", "Go t"),
]


@pytest.mark.parametrize(("page", "text"), EVERYTHING)
def test_all_that_is_visible(page, text):
    assert html.extract(page, everything=True) == text


@pytest.mark.parametrize("depth", [10, 1000])
def test_rules_hold_at_any_depth(depth):
    page = "<div>" * depth + "<div hidden>SECRET</div><template>TPL</template><ul><li>a<li>b</ul>"
    assert html.extract(page, everything=True) == "- a\n- b"


@pytest.mark.parametrize("bad", ["<b ", '<a x="', "<", "</", "<!--", "<p", "&#", "<a x=", "<b><i>"])
def test_a_megabyte_of_unclosed_tags_takes_no_time(bad):
    start = time.perf_counter()
    html.extract(bad * (1_000_000 // len(bad)), everything=True)
    assert time.perf_counter() - start < 20


class Plain(HTMLParser):
    """Words outside hidden elements, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<td>", "<tr>", "<table>", "</table>", "</td>", "<h1>", "</h1>", "<a>", "</a>", "<br>", "<pre>", "</pre>"]), st.sampled_from(["alpha", "beta", " ", "\n", "&amp;"])), max_size=40))
def test_no_visible_text_is_lost(parts):
    page = "".join(parts)
    plain = Plain()
    plain.feed(page)
    plain.close()
    joined = lambda words: sorted("".join(words).replace("|", ""))
    drop = lambda s: [c for c in s if c not in "-. 0123456789"]
    assert drop(joined(html.extract(page).split())) == drop(joined(plain.words))


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "x"), (2, None, None, "y"), (2, "", "", None), (None, "u", "<p>a", None)], "page_id long, url string, html string, text string")
    rows = html.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in rows) == [(0, "a", 1), (1, "a", 1), (2, "", 0), (2, "", 0)]
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    assert html.extract_pages(df.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        assert sorted("".join(plain.words)) == sorted("".join(texts[r.page_id].replace("\n- ", "\n").removeprefix("- ").split()))


def test_held_columns_against_a_dict():
    import random

    rng = random.Random(4)
    for _ in range(400):
        held, new, plain = [], [], {}
        for out in (held, new):
            at = 0
            for _ in range(rng.randint(0, 5)):
                a = at + rng.randint(0, 4)
                at = a + rng.randint(1, 5)
                out.append((a, at, rng.randint(1, 3)))
                plain.update(dict.fromkeys(range(a, at), out[-1][2]))
        found = html.covered(held, new)
        assert {c: u for a, b, u in found for c in range(a, b)} == plain
        assert found == sorted(found) and all(x[1] <= y[0] and not (x[1] == y[0] and x[2] == y[2]) for x, y in zip(found, found[1:]))


def test_pages_made_to_take_long():
    import time

    span = "<tr><td colspan=1000 rowspan=65534>x"
    for rows, seconds in ((300, 0.5), (3000, 20)):
        began = time.perf_counter()
        text = html.extract(f"<table>{span * rows}</table>", True)
        assert time.perf_counter() - began < seconds and text.count("x") == rows
    began = time.perf_counter()
    text = html.extract("<ul><li>x" * 100_000, True)
    assert len(text) < 100_000 * (html.INDENT + 10) and text.count("x") == 100_000 and time.perf_counter() - began < 30


def test_tables_of_very_many_columns_keep_all_text():
    cells = "".join(f"<td>c{k}" for k in range(1500))
    text = html.extract(f"<table><tr>{cells}<tr><td>a<td><td>b</table>", True)
    first, second = text.split("\n")
    assert [x.strip() for x in first.split("|")] == [f"c{k}" for k in range(1500)]
    assert [x.strip() for x in second.split("|")] == ["a", "", "b"]
