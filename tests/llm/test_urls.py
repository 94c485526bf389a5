from pyspark.sql import functions as F

from skyledger.llm import urls
from skyledger.llm.queries import URL_RULES


def pages(spark, addresses, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(addresses)), addresses, strict=True)), "page_id bigint, url string")


def plain(url):
    """(host, path, rule, verdict) by the contract; verdict None where the method decides."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


HARD = [None, "", "no scheme", "http://", "://", "http://ORG", "http://Org/", "https://a.org?x=/y", "http://x.com/de/1#f", "http://example.org/en/1",
        "http://m.example.org/en/19?p=1", "http://notexample.org/es/1", "http://example.org/es/", "http://example.org/es", "http://x.com/fr/a//b/", "ftp://É.com/fr/",
        "a://b://c.org/d", "http://x.net/" + "/".join(map(str, range(300))), "http://x.net/" + "s" * 4000, "http://x.com/de/\nq", "http://com/fr/", "http://.org/"]


def test_hosts_paths_and_rules(spark):
    many = HARD + [f"http://s{i % 7}.example.net/{'ab'[i % 2]}/{i}?u" for i in range(200)] + HARD
    rows = {r["page_id"]: r for r in urls.filter_urls(pages(spark, many).withColumns({c: F.lit("x") for c in ("host", "rule", "template", "_host", "rows")}), URL_RULES).collect()}
    assert len(rows) == len(many)
    for i, url in enumerate(many):
        host, path, rule, verdict = plain(url)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_templates_generalise_and_impure_ones_are_rejected(spark):
    rules = [("block", "shop.test", "/x/1"), ("allow", "shop.test", "/news/2")]
    addresses = [f"http://shop.test/x/{i}" for i in range(400)] + [f"http://shop.test/news/{i}.html" for i in range(400)] + ["http://shop.test/about"]
    rows = {r["url"]: r for r in urls.filter_urls(pages(spark, addresses), rules).join(pages(spark, addresses), "page_id").collect()}
    assert {rows[f"http://shop.test/x/{i}"]["template"] for i in range(400)} == {"/x/{9}"}
    assert {rows[f"http://shop.test/news/{i}.html"]["template"] for i in range(400)} == {"/news/{9}.html"}
    assert rows["http://shop.test/x/7"]["verdict"] == "block" and rows["http://shop.test/news/7.html"]["verdict"] == "allow"


def test_empty_table_and_repeated_rows(spark):
    one = pages(spark, ["http://a.net/b", "http://a.net/b", None], ids=[1, 1, None])
    assert urls.filter_urls(one, URL_RULES).count() == 3
    assert urls.filter_urls(one.where("false"), URL_RULES).count() == 0
    assert urls.filter_urls(one, []).where("rule is not null").count() == 0
