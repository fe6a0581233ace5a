import re

from quillon.llm.urlfilter import ALLOW, BLOCK, NODE, OP9_SQL, RULES, Trie, _parts, judge, op9_url_filters

URLS = [
    None, "", "no scheme", "http://", "http:///x", "://a.com/", "http://a.com", "http://a.com/", "http://a.com?x=/", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/", "https://example.com/en", "https://example.com/EN/1", "https://x.example.com/en/1?y#z", "https://www.example.com/en/9",
    "https://a.www.example.com/en/9", "https://notexample.com/en/1", "http://b.net/es/1", "http://b.net/fr/", "http://b.net/de/", "http://net/es/", "http://b.net:80/es/", "http://com/", "http://a.org/x://b.net/es/", "http://b.net#/es/", "http://b..com/x", "http://É.com/a\nb?c",
]


def brute(url, rules, default=ALLOW):
    u = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v == BLOCK, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, block, rule = max(fits)
        return host, path, rule, BLOCK if block else ALLOW
    return host, path, None, BLOCK if not host else default


def _judged(spark, urls, rules, **more):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, filtered int")
    made = judge(df, rules, **more)
    assert made.columns == ["page_id", "url", "filtered", "filtered_"]
    return {r["page_id"]: (r["filtered_"]["host"], r["filtered_"]["path"], r["filtered_"]["rule"], r["filtered_"]["verdict"]) for r in made.collect()}


def test_against_all_rules(spark):
    assert _judged(spark, URLS, RULES) == {i: brute(u, RULES) for i, u in enumerate(URLS)}


def test_partial_segments_ties_and_cut_lists(spark):
    rules = [(BLOCK, "a.com", "/en"), (ALLOW, "a.com", "/en"), (ALLOW, "a.com", "/english/x"), (BLOCK, "b.a.com", "/"), (ALLOW, "com", ""), (BLOCK, "a.com", "/e/f/g")]
    urls = ["http://a.com/en", "http://a.com/english", "http://a.com/english/x1", "http://b.a.com/english", "http://c.com", "http://a.com/e/f/gh", "http://a.com/e/f", "http://b.a.com"]
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert _judged(spark, urls, rules) == want
    assert _judged(spark, urls, rules, most=2) == want
    assert _judged(spark, urls, []) == {i: brute(u, []) for i, u in enumerate(urls)}


def test_lists_are_bounded_by_bytes():
    rules = [(BLOCK, f"h{i}.example.com", "/a/" * (i % 5)) for i in range(50)]
    parts = _parts(rules, 1000, 6 * NODE * 4)
    assert [r for p in parts for r in p] == rules and len(parts) > 5
    assert _parts([], 10) == [[]] and len(_parts(rules, 7)) == 8


def test_trie_walks_labels_and_segments():
    t = Trie(RULES)
    assert t.find("a.example.com", "/en/1") == (BLOCK, "example.com/en/")
    assert t.find("www.example.com", "/en/1") == (ALLOW, "www.example.com/en/")
    assert t.find("org", "/") == (None, None)


def test_sql_and_empty_table(spark, same_rows, tmp_path):
    d = "/root/testdata/sf0.001"
    same_rows(op9_url_filters(spark, d), OP9_SQL)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op9_url_filters(spark, str(tmp_path)).count() == 0
