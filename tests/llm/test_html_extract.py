import html
import re

import pytest

from plateflow.llm import html_extract as X
from plateflow.llm.queries import op5_html_extract

from .helpers import clashing

PAGES = "page_id long, url string, html string"


def article(page):
    """The article's blocks of the synthetic pages, which are all of one make."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\x00", body.replace("<br>", " "))).split("\x00")
    return "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if t)


def test_tables(spark, sf):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op5_html_extract(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == article(rows[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


FULL = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><div class="sidebar"><p>side</p></div><main><article class="post"><header><h1>Title &amp; more</h1></header>
<p>One <b>two</b><br>three &lt;x&gt; &#233;&nbsp;</p><script>var t="</p><p>";</script><ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table><form><p>sub</p></form>
<aside>x</aside><div class="comments"><p>bad</p></div><pre>  k   l </pre>loose text<p hidden>no</p><!-- <p>not</p> --></article></main>
<section id="comments"><p>nasty</p></section><footer>f</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (FULL, "Title & more\n\nOne two three <x> é\n\na\n\nb\n\nc1\n\nc2\n\nk l\n\nloose text"),
        (None, ""),
        ("", ""),
        ("plain text &amp; no markup", "plain text & no markup"),
        ("<p>First<p>Second<div class=advertisement>buy</div><nav><a href=x>menu</a></nav>", "First\n\nSecond"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<body><div class='entry-header'><h1>Own</h1></div><p title='a > b'>text</p></body>", "Own\n\ntext"),
        ("<script>never closed <p>x</p>", ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>one</b></i></p></div>two", "one\n\ntwo"),
        ("<p a='" * 300, ""),
    ],
)
def test_pages(spark, page, text):
    (row,) = X.main_text(clashing(spark.createDataFrame([(1, "http://h/x", page)], PAGES))).collect()
    assert row["text"] == text and row["n_chars"] == len(text)


def test_template_texts_go(spark):
    """Outside of articles, what every page of a host says is its template; other hosts' pages don't count."""
    page = lambda i: f"<body><div><p>All rights of this site</p></div><div><h2>Story {i}</h2><p>Words of story {i}.</p></div><div><a href=/>More links {i}</a></div></body>"
    rows = [(i, f"http://h{i % 2}/{i}", page(i)) for i in range(12)] + [(99, "//other", page(99)), (None, None, page(100))]
    got = {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert all(got[i] == f"Story {i}\n\nWords of story {i}." for i in range(12))
    assert "All rights" in got[99] and "All rights" in got[None]


def test_wrappers(spark):
    rows = [(1, "http://h/1", "<h1>A</h1><ul><li>x</li></ul><p>t</p>"), (2, "http://h/2", "<h1>A</h1><p>u</p><p>v</p>"), (3, "HTTP://H/3", "<h1>A</h1><ul><li>x</li><li>y</li></ul><p>w</p>")]
    (r,) = X.expressions(spark.createDataFrame(rows, PAGES)).collect()
    assert (r["host"], r["pages"]) == ("h", 3)
    assert r["expression"] == '<page><h1>"A"</h1>(<ul>(<li>#text</li>)+</ul>)?(<p>#text</p>)+</page>'


def test_groups_of_links_go(spark):
    """What the wrapper says is a repeated group of links goes as a whole; a list in which links are few stays."""
    links = "".join(f"<li><b>{w}</b> <a href=/{w}>All about the word {w}</a></li>" for w in ("one", "two", "three"))
    items = "".join(f"<li>Point {w} of this story, see <a href=/>here</a></li>" for w in ("one", "two"))
    page = lambda i: f"<body><h1>Title {i}</h1><ol>{items}</ol><p>Text {i}.</p><ul>{links}</ul></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(3)]
    for r in X.main_text(spark.createDataFrame(rows, PAGES)).collect():
        assert "All about" not in r["text"] and r["text"].startswith(f"Title {r['page_id']}") and f"Text {r['page_id']}." in r["text"]


def brute_wrapper(pages):
    """By plain dictionaries of label paths: on how many pages each place is, and its letters and those in links."""
    places = {}
    for tokens in pages:
        path, own = [], {}
        for kind, value, linked in tokens:
            if kind == 1:
                path.append(value)
                own.setdefault(tuple(path), [0, 0])
            elif kind == -1:
                path.pop()
            else:
                own.setdefault(tuple(path), [0, 0])
                own[tuple(path)][0] += len(value)
                own[tuple(path)][1] += linked
        for p, (letters, linked) in own.items():
            at = places.setdefault(p, [0, 0, 0])
            at[0] += 1
            at[1] += letters
            at[2] += linked
    return places


def test_wrappers_against_plain_dictionaries(spark, sf):
    """Each host's wrapper has a place for each path of any of its pages, and no other, with the same letters."""
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    by_host = {}
    for r in rows.collect():
        by_host.setdefault(X.host(r["url"]), []).append(X.stream(r["html"]))
    import pickle

    for r in X.wrappers(rows.repartition(5)).collect():
        found = {}

        def walk(e, path):
            found[path] = (e.slot.letters, e.slot.linked) if e.slot else (0, 0)
            for g in e.groups:
                for x in g.elements.values():
                    assert x.label not in [p[-1] for p in found if len(p) == len(path) + 1 and p[:-1] == path]
                    walk(x, (*path, x.label))

        walk(pickle.loads(r["wrapper"]), ())
        want = {p: (n[1], n[2]) for p, n in brute_wrapper(by_host[r["host"]]).items()}
        want.setdefault((), (0, 0))
        assert r["pages"] == len(by_host[r["host"]]) and found == want


def test_order_of_pages_does_not_change_what_is_kept(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    trees = [X.wrapper(X.stream(r["html"])) for r in rows[:20]]
    again = [X.wrapper(X.stream(r["html"])) for r in rows[19::-1]]
    for a in (trees, again):
        for t in a[1:]:
            a[0].merge(t)
    assert X.main_slots(trees[0]).keys() == X.main_slots(again[0]).keys()


def test_empty(spark):
    assert X.main_text(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div><article>" + "<div>" * 60 + "deep" + "</div>" * 60 + "<p>rest</p></article></div></body>", "deep\n\nrest"),
        ("<body><p>a</p><div class=comments>" + "<div>" * 60 + "deep" + "</div>" * 60 + "<p>thread</p></div><p>b</p></body>", "a\n\nb"),
        ("<div>" * 60 + "one<nav><div>menu</div></nav>two" + "</div>" * 60, "one\n\ntwo"),
        ("<div>" * 60 + "out<article><header>own</header><div>in<nav>menu</nav></div></article>out" + "</div>" * 60, "own\n\nin"),
        ("<table><tr><td>" + "<div>" * 60 + "x</section></div><td>y<tr><td>z</table>end", "x\n\ny\n\nz\n\nend"),
        ("<div>" * 60 + "<nav>" * 3000 + "menu" + "</nav>" * 3000 + "text" + "</section>" * 3000, "text"),
    ],
)
def test_below_the_depth_of_wrappers(page, text):
    """Deep elements are closed by their own tags, and what they are still counts."""
    tokens = X.stream(page)
    assert X.extract(tokens, X.main_slots(X.wrapper(tokens))) == text


def test_template_texts_go_among_many_others(spark):
    """What stands on four of five pages is template however many texts its slot has; what stands on fewer isn't, however often."""
    notices = ["Call us from nine to five", "Free delivery from ten"]

    def page(i):
        own = [f"Paragraph {j} of story {i}." for j in range(100)]
        return own, "<body><div>" + "".join(f"<p>{t}</p>" for t in [notices[0], *own, *([notices[1]] if i % 5 else ["Seldom said", "Seldom said"] * 5)]) + "</div></body>"

    rows = [(i, f"http://h/{i}", page(i)[1]) for i in range(40)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in X.main_text(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert all(got[i] == page(i)[0] + ([] if i % 5 else ["Seldom said"] * 10) for i in range(40))
