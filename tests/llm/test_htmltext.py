import collections
import html as h
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import htmltext
from quillon.llm.htmltext import OP3_SQL, Page, article, extract, op3_html_extraction, templates
from tests.llm.conftest import prose

@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a</p>", "a"),
        ("just &amp; text", "just & text"),
        ("<nav>menu</nav><article><h1>T</h1><p>a  b\n c</p></article><footer>f</footer>", "T a b c"),
        ("<article><p>one<p>two<br>three<ul><li>x<li>y</ul></article>", "one two three x y"),
        ("<article>a<em>b</em>c <b>d</b>&nbsp;e&lt;p&gt;&#233;&#x1F600;</article>", "abc d e<p>é😀"),
        ("<article>a<script>var x='</p>'</script><style>p{}</style><!-- c -->b</article>", "ab"),
        ("<article>a<form>f<input></form><aside>s</aside><div class='ad'>x</div><div id=comments><p>c</p></div>b</article>", "a b"),
        ("<main><div class='cookie-notice'>n</div><section class='comments-area'>c</section><p>t</p></main>", "t"),
        ("<body class='has-sidebar'><div class='sidebar'>s</div><div class='content'><p>t</p></div></body>", "t"),
        ("<div id=page><p>out</p><div id=main><p>out too</p><div class='post-content'><p>in</p></div></div></div>", "in"),
        ("<div id=main><p>in</p><div class='user-comments'>c</div><div class='right-rail'>r</div><div class=adsbygoogle>x</div></div><p>out</p>", "in"),
        ("<article>a <span class=ad>x <span>y</span> z</span> b <span>c</span></article>", "a b c"),
        ("<div role=banner>h</div><div role=main>t</div><div role='contentinfo'>f</div>", "t"),
        ("<article>a<div hidden>h</div><span style='display: none'>x</span><i aria-hidden=true>y</i>b</article>", "a b"),
        ("<article><p>unclosed <b>bold<div class=ad>x</div>tail</article>after", "unclosed bold tail"),
        ("<article>1 < 2 and a<b>c</b> <a href=\"x>y\">l</a></article>", "1 < 2 and ac l"),
        ("<article></p></div>a</article></div>", "a"),
        ("<article>a<p class='share-buttons'>s</p><article class='comment'>c</article></article>", "a"),
        ("<p>plain " + "<a href=x>link text</a>" * 3 + "</p><p>words here</p>", "words here"),
    ],
)
def test_pages(source, want):
    assert article(source) == want


def test_articles_of_real_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", ""))).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def _site(n, article_tag=False):
    """Pages of one host: a logo, a changing body, a slogan repeated on each page; no telling names."""
    tag = "article" if article_tag else "div"
    return [(i, f"http://h.example/{i}", f"<html><body><div><p>The Daily Slogan</p></div><div><p>{prose(i, 30)}</p><{tag}><p>{prose(i + 999, 40)}</p><p>Read more in our app</p></{tag}></div><div><p>All rights kept</p></div></body></html>") for i in range(n)]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_templates_of_a_host(spark, monkeypatch, limit):
    """The main slot is found without telling names, with the templates sent or joined."""
    monkeypatch.setattr(htmltext, "BROADCAST", limit)
    df = spark.createDataFrame(_site(9) + [(100, "http://alone.example/", "<p>The Daily Slogan</p>"), (101, None, None)], "page_id long, url string, html string").repartition(3)
    got = {r["page"]: r["text"] for r in extract(df).collect()}
    assert got == {i: f"{prose(i, 30)} {prose(i + 999, 40)} Read more in our app" for i in range(9)} | {100: "The Daily Slogan", 101: ""}
    flat = [(i, "http://flat.example/", f"<p>The Daily Slogan</p><p>{prose(i, 30)}</p><p>{prose(i + 50, 30)}</p><p>All rights kept</p>") for i in range(5)]
    got = {r["page"]: r["text"] for r in extract(spark.createDataFrame(flat, "page_id long, url string, html string")).collect()}
    assert all(v.startswith(f"{prose(i, 30)} {prose(i + 50, 30)}") and "Slogan" not in v for i, v in got.items())


def test_text_in_an_article_stays(spark):
    for n in (4, 12, 40):
        rows = extract(spark.createDataFrame(_site(n, True), "page_id long, url string, html string")).collect()
        assert all(r["text"] == f"{prose(r['page'] + 999, 40)} Read more in our app" for r in rows)


def _renamed(html):
    """The page without article tags and telling names."""
    html = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", html)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def test_the_template_alone_finds_the_article(spark):
    """Menus, slogans and footers of changing text around an article of a few paragraphs, all in plain elements."""
    rows = []
    for i in range(12):
        body = "".join(f"<p>{prose(i * 50 + j, 40)}</p>" for j in range(3 + i % 4))
        rows.append((i, "http://plain.example/", f"<body><div><ul>{''.join(f'<li>{prose(i + k, 2)}</li>' for k in range(i % 5 + 2))}</ul></div><div><div><p>Today</p><p>{prose(i + 7000, 6)}</p></div><div><h1>{prose(i + 8000, 5)}</h1>{body}</div></div><div><p>{prose(i + 9000, 9)}</p></div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: " ".join([prose(i + 8000, 5), *(prose(i * 50 + j, 40) for j in range(3 + i % 4))]) for i in range(12)}
    assert {r["page"]: r["text"] for r in extract(df).collect()} == want
    assert all(article(r[2]) != want[r[0]] for r in rows)


def test_real_pages_without_their_markup(spark):
    """Of real pages without article tags and names, those of hosts with three pages and more are mostly read from the template."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = {r["page_id"]: article(r["html"]) for r in df}
    bare = [(r["page_id"], r["url"], _renamed(r["html"])) for r in df]
    got = {r["page"]: r["text"] for r in extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    right, alone = sum(got[i] == t for i, t in want.items()), sum(article(h) == want[i] for i, _, h in bare)
    assert right > 0.5 * len(bare) and alone < 0.05 * len(bare), (right, alone, len(bare))


@pytest.mark.parametrize("n", [8, 50, 1000])
def test_repeated_rows_keep_their_article(spark, n):
    one = f"<div><p>menu</p></div><div><p>{prose(1, 40)}</p><p>{prose(2, 30)}</p></div>"
    rows = [(i, "http://same.example/", one) for i in range(n)] + [(5000 + i, "http://marked.example/", f"<nav>n</nav><article><p>{prose(3, 40)}</p><p>same for all</p></article>") for i in range(n)]
    got = {r["page"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"menu {prose(1, 40)} {prose(2, 30)}" and got[5000 + i] == f"{prose(3, 40)} same for all" for i in range(n))


def test_any_depth():
    deep = "<div>" * 3000
    assert article(f"<nav>x</nav>{deep}<article><p>in</p></article>{'</div>' * 3000}<footer>f</footer>") == "in"
    assert Page(f"{deep}<p>a</p>").tokens[-1] != Page(f"{deep}<div><p>a</p>").tokens[-1]


@pytest.mark.parametrize("name", ["announcement-body", "social-history", "search-results", "related-work", "side-effects", "comments-on-law", "headerless", "advance", "promote", "noticeable", "menuet"])
def test_honest_names_are_kept(name):
    assert article(f"<article>a<div class='{name}'>b</div></article>") == "a b"


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "ad_3", "top-ad", "sidebar-right", "site-header", "page-footer", "comments-area", "user-comments", "cookie-notice", "share-buttons", "newsletter-form", "related-links", "nav-links"])
def test_telling_names_are_left_out(name):
    assert article(f"<article>a<div class='{name}'>b</div></article>") == "a"


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_copies_of_a_page_are_no_template(spark, monkeypatch, limit):
    """Repeated rows and copies of an article keep their text, and don't hide the template of the other pages."""
    monkeypatch.setattr(htmltext, "BROADCAST", limit)
    copy = f"<nav>n</nav><article><p>{prose(1, 40)}</p><p>{prose(2, 30)}</p></article>"
    near = [(i, "http://near.example/", f"<nav>menu {i}</nav><article><p>{prose(3, 40)}</p><p>{prose(4, 30)}</p></article>") for i in range(20, 30)]
    plain = f"<div class=content><p>{prose(5, 40)}</p><p>{prose(6, 30)}</p></div>"
    mixed = _site(9)
    rows = [(i, "http://copy.example/", copy) for i in range(10)] + near + [(40 + i, "http://rows.example/", plain) for i in range(3)] + [(100 + i, u, x) for i, u, x in mixed] + [(200 + i, *mixed[0][1:]) for i in range(30)]
    got = {r["page"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    own = {i: f"{prose(i, 30)} {prose(i + 999, 40)} Read more in our app" for i in range(9)}
    want = {i: f"{prose(1, 40)} {prose(2, 30)}" for i in range(10)} | {i: f"{prose(3, 40)} {prose(4, 30)}" for i in range(20, 30)} | {40 + i: f"{prose(5, 40)} {prose(6, 30)}" for i in range(3)}
    assert got == want | {100 + i: own[i] for i in range(9)} | {200 + i: own[0] for i in range(30)}


def test_classes_are_those_of_equal_vectors(spark):
    """Against classes from whole occurrence vectors, for pages with parts on some of them."""
    r = random.Random(6)
    rows = []
    for i in range(14):
        parts = [f"<div class=k{k}><p>part {k}</p><p>more {k}</p></div>" for k in range(8) if r.random() < (0.3, 0.6, 0.8, 1)[k % 4]]
        rows.append((i, "h", f"<body><p>every</p>{''.join(parts)}<div><p>own {i}</p></div><p>end</p></body>"))
    vectors, places, kinds = collections.defaultdict(collections.Counter), collections.defaultdict(list), {}
    for i, _, html in rows:
        page = Page(html)
        n = len(page.elements) + len(page.blocks)
        first = {}
        for token, _, kind, _, place in page.occurring():
            vectors[token][i] += 1
            first.setdefault(token, place / n)
            kinds[token] = kind
        for token, place in first.items():
            places[token].append(place)
    classes = collections.defaultdict(list)
    for token, v in vectors.items():
        if len(v) >= 7:
            classes[tuple(sorted(v.items()))].append(token)
    kept = []
    for v, own in sorted(classes.items(), key=lambda c: (-len(c[0]), -len(c[1]), min(sum(places[t]) / len(places[t]) for t in c[1]))):
        at = [sum(places[t]) / len(places[t]) for t in own]
        a, b = min(at), max(at)
        if len(own) >= 2 and all(a >= x and b <= y or a <= x and b >= y or b < x or a > y for x, y, _ in kept):
            kept.append((a, b, own))
    want = sorted(t for *_, own in kept for t in own if kinds[t] == 0)
    made = templates(spark.createDataFrame(rows, "row long, host string, html string").repartition(4)).collect()
    assert len(made) == 1 and made[0]["tokens"] == want and len(want) > 4


def test_odd_rows(spark, tmp_path):
    rows = [(1, "http://a.b/", "<article>x</article>", 1), (1, "http://a.b/", "<article>x</article>", 1), (None, None, None, 1), (2, "", "", 1), (3, "http://a.b/", "<article>" + "<p>" + prose(1, 200_000) + "</article>", 1), (4, "http://a.b/", "<" * 5000 + "<a " * 3000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("row", F.lit(1)).withColumn("tokens", F.lit(2)).withColumn("page", F.lit(3))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op3_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"] for r in got}[3] == prose(1, 200_000)
    assert extract(df.where("page_id = -1")).count() == 0


def test_sql(spark, same_rows):
    d = "/root/testdata/sf0.001"
    same_rows(op3_html_extraction(spark, d), OP3_SQL)
