import html
import random
import re

import pytest

from threadloom.llm import extraction, pages

PAGES = "page_id long, url string, html string, host string, text string, wrapper int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


def texts(spark, rows, parts=3):
    return {r["page_id"]: r["text"] for r in extraction.extract(table(spark, rows).repartition(parts)).collect()}


def shape(page):
    return pages.stream(pages.parse(page))


def spell(items):
    out = ""
    for key, optional, repeated, inner in items:
        one = f"({spell(inner)})" if key == "()" else key + (f"[{spell(inner)}]" if inner else "")
        out += one + ("*" if optional and repeated else "?" if optional else "+" if repeated else "") + " "
    return out.strip()


def test_mismatches_become_optional_or_repeated():
    assert spell(shape("<ul><li>a<li>b<li>c</ul>")) == "ul[li[#]+]"
    assert spell(shape("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "dl[(dt[#] dd[#])+]"
    one, two = shape("<h1>t</h1><p>a</p><div>x</div><p>b</p>"), shape("<h1>t</h1><p>a</p><p>b<p>c")
    assert spell(pages.merged(one, two)) == "h1[#] p[#]+ div[#]? p[#]?"
    assert pages.merged(one, one) == one
    three = shape("<h1>u</h1><table><tr><td>1</td></tr></table><p>a</p>")
    assert spell(pages.merged(one, three)) == "h1[#] table[tr[td[#]]]? p[#] div[#]? p[#]?"
    wide = pages.merged(shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>"), shape("<dl><dt>a<dd>b</dl>"))
    assert spell(wide) == "dl[(dt[#] dd[#])+]"


def test_text_of_marked_pages(spark):
    page = """<!DOCTYPE html><head><title>No</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>Home</ul></nav><!-- <article>no</article> --><div class="ad">Buy</div><main><p>lead</p><article class="post"><header class="byline"><h1>Title &amp; more</h1>by X</header>
    <p>One <b>bold</b>&nbsp;word,\n  <a href="x">link</a> &copy; &lt;p&gt; &am <br>end.<p>Two<div>three<form>Name <input value="n"><button>Go</button></form> four</div><aside>side</aside>
    <ul><li>x<li>y</ul><section id="comments"><article class="comment">first!</article></section><span class="sponsored">ad</span>tail
    <div class="cookie-notice">cookies</div><table><tr><td>a<td>b</table><footer>foot</footer></article><p>after</main><footer>end</footer>"""
    want = "Title & more\nOne bold word, link © <p> &am end.\nTwo\nthree\nfour\nx\ny\ntail\na\nb"
    odd = [(1, "http://a.com/1", page), (2, "http://a.com/2", page.replace("<article class=\"post\">", "<section>").replace("</article><p>after", "</section><p>after")),
           (3, "http://a.com/3", ""), (4, "http://a.com/4", None), (5, None, "<article>only</article>"), (6, "no host", "<article><p>a<article>b</article>c"),
           (7, "http://b.com", "<article>" + "<div>" * 5_000 + "deep" + "</div>" * 5_000 + " out</article> no"), (8, "http://b.com", "<article>" + "word " * 300_000),
           (9, "http://c.com", "<article><p title='a > b' class=x>1 < 2 <p a=\"q>rest</article>"), (9, "http://c.com", "<article><p title='a > b' class=x>1 < 2 <p a=\"q>rest</article>")]
    got = texts(spark, odd)
    assert got[1] == want and got[3] == got[4] == "" and got[5] == "only" and got[6] == "a\nb\nc" and got[7] == "deep\nout"
    assert got[8] == ("word " * 300_000).strip() and got[9] == "1 < 2\nrest"
    assert got[2].startswith("lead\nTitle & more\nOne bold word") and got[2].endswith("a\nb\nafter")
    assert extraction.extract(table(spark, odd)).filter("page_id = 9").count() == 2
    assert extraction.extract(table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def unmarked():
    """Pages of one host without an article: only what differs from page to page, and where, tells the text from the rest."""
    rng, rows, want = random.Random(9), [], {}
    for i in range(150):
        said = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(15, 40))) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            said.insert(rng.randrange(len(said) + 1), "The same line again.")
        links = "".join(f'<a href="/{j}">go {rng.randrange(99)}</a> ' for j in range(rng.randrange(2, 5)))
        extra = "<div>More to read here</div>" if rng.random() < 0.5 else ""
        body = "".join(f"<p>{html.escape(s)}</p>" for s in said)
        rows.append((i, "http://plain.org/p", f"<body><div>Welcome to the site</div><div>{links}</div>{extra}<div><div>{body}</div></div><div>All rights reserved</div></body>"))
        want[i] = "\n".join(said)
    return rows, want


def test_text_of_pages_that_mark_nothing(spark, unmarked):
    rows, want = unmarked
    assert texts(spark, rows) == want


def test_rounds_and_partitions_do_not_matter(spark, unmarked, monkeypatch):
    rows, want = unmarked
    monkeypatch.setattr(extraction, "MERGED_AT_ONCE", 4)
    monkeypatch.setattr(extraction, "BROADCAST_WRAPPERS", 0)
    assert texts(spark, rows + [(500, "http://a.com", "<article>x</article>")], parts=7) == {**want, 500: "x"}


def test_query_against_a_plain_cut(spark):
    """The test pages have one article without anything else in it, so its text can be cut out by hand."""
    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    source = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in entry_points.queries()["op12_html_text"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", source[row["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"]) and row["url"] == source[row["page_id"]]["url"]
