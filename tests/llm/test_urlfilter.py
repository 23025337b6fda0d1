from veridale.llm import urlfilter
from veridale.llm.queries import URL_RULES, op7_url_filters


def plain(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(str(r)), default=None)


def test_op7_rules(spark, small):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op7_url_filters(spark, small).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and str(rule))
        assert r.verdict == (rule.verdict if rule else "allow")


def test_aliases_and_odd_urls(spark):
    link = '<html><LINK href="{}" rel=canonical>'
    rows = [
        (1, "http://bad.com/de/1", None), (2, "http://other.net/x#f", link.format("https://bad.com/de/1")), (3, "http://third.net/y", '<meta http-equiv="refresh" content="0; url=http://other.net/x">'),
        (4, "http://bad.com/de/2", None), (5, "http://ok.net/z", link.format("//bad.com/de/2")), (6, "http://ok.org/a", link.format("http://ok.net/z")),
        (7, None, link.format("http://bad.com/de/1")), (8, "no scheme", ""), (9, "HTTP://A.COM", None), (10, "http://ÄB.com?x=/de/", None), (11, "http://p.net/q/r", link.format("s")), (12, "http://p.net/q/s", link.format("/t")),
        (13, "http://p.net/t", link.format("http://bad.com/de/1?a=1")), (14, "http://bad.com/de/1?a=1#x", None), (14, "http://bad.com/de/1?a=1#x", None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://from.net/", "http://third.net/y"), (None, "http://x.net/")], "from_url string, to_url string")
    more = pages.unionByName(spark.createDataFrame([(15, "http://from.net/", None, "v")], pages.schema))
    out = {r.page_id: r for r in urlfilter.judged(more, URL_RULES, redirects).collect()}
    assert {k for k, r in out.items() if r.verdict == "block"} == {1, 2, 3, 4, 11, 12, 13, 14, 15}
    assert out[5].verdict == "allow"  # an allowed page is among its aliases
    for k, url, _ in rows:
        assert (out[k].host, out[k].path) == plain(url)[:2]
    assert urlfilter.judged(pages, URL_RULES).count() == len(rows) and urlfilter.judged(pages.limit(0), URL_RULES).count() == 0


def test_every_link_of_a_page_passes_a_block(spark):
    own, to = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://bad.com/de/1", ""), (2, "http://a.net/x", own.format("http://a.net/x") + to.format("http://bad.com/de/1")), (3, "http://b.net/y", own.format("http://a.net/x")),
        (4, "http://c.net/z", own.format("http://c.net/z") + own.format("http://b.net/y")), (5, "http://d.net/", to.format("/") + to.format("http://c.net/z")), (6, "http://e.net/", own.format("http://e.net/"))]
    out = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}
