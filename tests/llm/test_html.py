import time

import pytest

from breezeframe.llm import html_extract as he
from breezeframe.llm.html_samples import sample_pages


@pytest.fixture(scope="module")
def model(spark):
    return he.trained(spark)


def truth(page):
    p = he.parse(page)
    y = [False] * len(p.tags)
    for k in range(1, len(y)):
        y[k] = 'data-y="1"' in p.attrs[k] or (y[p.parent[k]] and 'data-y="0"' not in p.attrs[k])
    import numpy as np

    return he.main_text(p, np.array(y))


def test_unseen_pages(model):
    pages = sample_pages(200, seed=99)
    got = he.extract(pages, model)
    same = sum(a == truth(p) for a, p in zip(got, pages))
    assert same >= 0.85 * len(pages)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><div id="cookie-notice">We use cookies. Accept them please.</div>
<article><h1>A title &amp; more</h1><p><b>First  line here, with words.<br><p>Second&nbsp;one is <em>long</em>er &lt;ok&gt; and goes on for a while.
<div class="ad">Buy this thing now, it is very good.</div><p>Third paragraph ends the text of this page.</article>
<aside class="sidebar"><p>Other stories that you may like to read today.</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this text a lot, thank you.</p></div></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; site &middot; All rights reserved.</footer></body></html>"""


def test_whole_page(model):
    want = "A title & more First line here, with words. Second one is longer <ok> and goes on for a while. Third paragraph ends the text of this page."
    assert he.extract([PAGE], model) == [want]


def test_decoding_keeps_nothing_below_what_it_drops(model):
    import numpy as np

    pages = [he.parse(p) for p in sample_pages(30, seed=5)]
    odds = np.random.default_rng(1).normal(size=sum(len(p.tags) for p in pages)) * 3
    kept, base = he.decode(pages, odds), 0
    for p in pages:
        for k in range(1, len(p.tags)):
            assert not kept[base + k] or kept[base + p.parent[k]]
        base += len(p.tags)


def test_broken_markup_and_nulls(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "no markup at all"), (5, "u", "</div></p><article><p>x &#233; y</article>"), (6, "u", "<script>never closed"), (7, "u", "<article><p>" + "word " * 50_000), (7, "u", "<div>" * 3000 + "deep"), (None, "u", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = he.extract_pages(df, model).collect()
    assert len(out) == len(rows) and all(r["text"] is not None for r in out)
    by = {(r["page_id"], len(r["text"]) > 100): r["text"] for r in out}
    assert by[(1, False)] == "" and by[(5, False)] == "x é y" and by[(7, True)].count("word") == 50_000
    assert he.extract_pages(df.limit(0), model).count() == 0


def test_quotes_count_after_an_equals_sign_only():
    said = lambda h: [t for _, t in he.parse(h).runs if t]
    assert said("<p title=don't>Hello there.</p><p>It's late.</p>") == ["Hello there.", "It's late."]
    assert said("<p a=\"x>y\" b='>'>k</p></q>l") == ["k", "l"] and said("a < b <c") == ["a < b "]


@pytest.mark.parametrize("make", [lambda n: "<a " * n, lambda n: "<div>" * n + "</x>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<!--" * n, lambda n: '<a b="' * n, lambda n: "<li><b>" * n, lambda n: "<p><li>" + "<b>" * n + "<hr>" * n, lambda n: "<td><ul>" + "<b>" * n + "<td/>" * n])
def test_parsing_takes_linear_time(make):
    began = time.process_time()
    he.parse(make(40_000))
    assert time.process_time() - began < 10


def test_query(spark, model):
    """Texts of the query are those of one page at a time, and its counts are theirs; most equal the article's own text."""
    data = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = he.op5_html(spark, data).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["text"] == he.extract([pages[r["page_id"]]["html"] or ""], model)[0] and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_a_comment_that_never_ends_has_no_text():
    for at in ("", "x", "<p>before</p>"):
        page = he.parse(f"{at}<!-- secret menu <p>Hello")
        assert "secret" not in "".join(t or "" for _, t in page.runs) and "Hello" not in "".join(t or "" for _, t in page.runs)


def test_which_elements_a_new_one_closes():
    """Inline elements between don't matter to a paragraph's end; lists and tables keep what is outside them open."""
    def path(html):
        p = he.parse(html)
        k, out = len(p.tags) - 1, []
        while k > 0:
            out.insert(0, p.tags[k])
            k = p.parent[k]
        return " ".join(out)

    assert path("<p><b><i><div>") == "div" and path("<div><b><p><i><ul>") == "div b ul" and path("<p><li><b><ul>") == "p li b ul"
    assert path("<ul><li><b><li>") == "ul li" and path("<ul><li><ol><b><li>") == "ul li ol b li" and path("<li><span><b></b><b><li>") == "li"
    assert path("<table><tr><td><b><td>") == "table tr td" and path("<table><tr><td><i><tr>") == "table tr" and path("<table><tr><td><table><tr><td><td>") == "table tr td table tr td"
    assert path("<td><ul><b><td/><td>") == "td ul b td" and path("<dl><dt><b><dd><i><dt>") == "dl dt"
