"""Article extraction: a plain reading of the given pages, planted layouts, alignment and the defined cases."""

import html
import random
import re

import pytest

from riskspark.llm import html_wrapper as hw
from riskspark.llm.common import table
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string, host string, text string, places string, items string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def plain(source):
    """The text of a page of the given tables, by cutting strings."""
    body = source.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
    parts = re.split("</?(?:p|h1)>", body.replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in table(spark, SF_SMALL, "pages").collect()}
    got = hw.main_text(table(spark, SF_SMALL, "pages")).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


WORDS = "some plain words of an article about rivers ships harbours winds and old maps".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 40))).capitalize() + "."


LAYOUTS = {
    "article": "<header><h2>Site</h2><nav><a href=/>Home</a></nav></header><aside>Popular now</aside><article>{0}</article><section class='comments'><article><p>Reader says so.</p></article></section><footer>Foot</footer>",
    "main": "<div id=top-menu><ul><li>Menu</ul></div><main class='page-12'><div class=breadcrumb>Home</div>{0}<div class='ad-slot'>Buy it</div><form><p>Your mail</p><input></form></main><div class=footer>Foot</div>",
    "role": "<div class='siteHeader'>Name</div><div role=main>{0}<div class='cookie-notice'><p>We use cookies on this page.</p></div></div><div id='comments'><p>First!</p></div>",
    "plain": "<div><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div><div><div>{0}</div><p>Printed on paper that grows again.</p></div><div><small>All rights reserved by the house.</small></div>",
    "late": "<div class='sidebar'><p>Side words</p></div><div class=wrapper><div class=post>{0}<div class='share-buttons'>Tell others</div></div></div><div class='newsletter'><p>Letters by mail.</p></div>",
}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    pages, want = [], {}
    for name, layout in LAYOUTS.items():
        for i in range(9):
            texts = [sentence(rng) for _ in range(rng.randint(2, 9))]
            body = "".join(f"<h2>{t}</h2>" if j % 4 == 3 else f"<ul><li>{t}</ul>" if j % 5 == 4 else f"<p>\n {t.replace(' ', '  ', 1)}\t<p/>" for j, t in enumerate(texts))
            page = f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{layout.format(body)}<script>if (1 < 2) document.write('<p>no</p>')</script></body></html>"
            pages.append((len(pages), f"http://{name}.example/{i}", page))
            want[len(pages) - 1] = "\n".join(texts)
    return pages, want


def test_planted_layouts(spark, planted):
    pages, want = planted
    got = {r.page_id: r.text for r in hw.main_text(frame(spark, pages).repartition(7)).collect()}
    assert got == want


def test_merge_rounds(spark, planted, monkeypatch):
    """A host that is spread over many tasks ends as one wrapper."""
    monkeypatch.setattr(hw, "FAN", 2)
    pages, want = planted
    found = hw.wrappers(frame(spark, pages).repartition(11)).collect()
    assert sorted((r.host, r.pages) for r in found) == sorted((f"{n}.example", 9) for n in LAYOUTS)
    assert "( <p>" in next(r.wrapper for r in found if r.host == "article.example")


def read(source, others=()):
    items = hw.items_of(hw.parse(source))
    for o in others:
        items = hw.align(items, hw.items_of(hw.parse(o)))
    return hw.article(source, hw.rule(items))


def test_blocks():
    assert read("<article>a&amp;b &lt;c&gt; &eacute;&#8364;&#x41;&nbsp;x<p>one<b>two</b> <i>three</i><br>four<p>five</article>") == "a&b <c> é€A x\nonetwo three four\nfive"
    assert read("<article><p>kept <span class=ad>gone</span>too</p><!-- <p>no</p> --><p>then</article>") == "kept too\nthen"
    assert read("<article><header class='post-header'>x</header><div class='article-header'>Title</div><table><tr><td>a<td>b</table></article>") == "Title\na\nb"
    assert read("<article><p>a < b and c > d, x<y</p><p title='>'>e</article>") == "a < b and c > d, x\ne"  # the name of the element that <y starts is "y<"
    assert read("text alone") == "text alone" and read("<p>open <b>ended") == "open ended"
    assert read("") == read("<!-- only") == read("<script>x") == read("<article></article>") == ""
    deep = "<div>" * 3000 + "core" + "</div>" * 3000 + "<p>after"
    assert read(deep) == "core\nafter"
    assert read("<article>" + "<p>word" * 20000 + "</article>") == "\n".join(["word"] * 20000)


def test_template_texts():
    pages = [f"<div><p>{w} changes</p><h4>Always the same.</h4></div>" for w in ("one", "two", "three")]
    assert read(pages[0], pages[1:]) == "one changes"
    assert read(pages[0]) == "one changes\nAlways the same."
    assert read(pages[0], [pages[0]] * 5) == "one changes\nAlways the same."  # copies alone show no template


def matches(items, tokens):
    """The token lists left after every way in which ``items`` can match the front of ``tokens``."""
    ends = {0}
    for x in items:
        ends = {e + k for e in ends for k in one(x, tokens[e:])}
    return ends


def one(x, tokens):
    if x[0] == "t":
        return {1} if tokens and tokens[0] == "t" else set()
    if x[0] == "e":
        return {1} if tokens and tokens[0] == x[1] else set()
    if x[0] == "?":
        return {0} | one(x[1], tokens)
    seen, todo = set(), {0}
    while todo:
        step = {e + k for e in todo for k in matches(x[1], tokens[e:])}
        todo = step - seen
        seen |= step
    return seen


def test_wrappers_match_their_pages():
    """Each page that was aligned is a word of the wrapper's expression (element by element at the top level)."""
    rng = random.Random(6)
    for _ in range(200):
        pages = [[rng.choice(["p", "h2", "ul", "t", "div.a"]) for _ in range(rng.randint(0, 9))] for _ in range(5)]
        pages = [[t for i, t in enumerate(p) if not (t == "t" and i and p[i - 1] == "t")] for p in pages]
        items = None
        for p in pages:
            new = hw.fold([["t", rng.choice([1, 2]), 3, 0, 1] if t == "t" else ["e", t, []] for t in p])
            items = new if items is None else hw.align(items, new)
        for p in pages:
            assert len(p) in matches(items, p), (pages, hw.render(items))


def test_wide_pages_stay_bounded():
    rng = random.Random(7)
    items = []
    for _ in range(60):
        page = "".join(f"<div class=c{''.join(rng.choice('abcdefgh') for _ in range(5))}><p>x</div>" for _ in range(40))
        items = hw.align(items, hw.items_of(hw.parse(page)))
    assert len(hw.render(items)) < 20_000


def test_defined_cases(spark):
    pages = [(1, None, None), (None, "http://a.example/", "<article>a</article>"), (2, "no url", "<p>b"), (2, "no url", "<p>b"), (3, "HTTP://u@A.example:80/x", "<article>" + "é " * 50000 + "</article>"), (4, "http://a.example", "")]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in hw.main_text(frame(spark, pages)).collect()), key=repr)
    want = [(1, None, "", 0), (None, "http://a.example/", "a", 1), (2, "no url", "b", 1), (2, "no url", "b", 1), (3, "HTTP://u@A.example:80/x", " ".join("é" * 50000), 99999), (4, "http://a.example", "", 0)]
    assert got == sorted(want, key=repr)
    assert hw.main_text(frame(spark, [])).count() == 0
