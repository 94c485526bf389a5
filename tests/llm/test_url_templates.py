"""Templates of sites with many pages an id, repeated urls, several families, few labels and deep paths."""

from skyledger.llm import urls

from .test_urls import pages


def templates(spark, addresses, rules=()):
    found = urls.filter_urls(pages(spark, addresses), rules).select("page_id", "template", "verdict").collect()
    return {addresses[r["page_id"]]: (r["template"], r["verdict"]) for r in found}


def test_ids_with_many_pages_and_repeats_become_wildcards(spark):
    addresses = [f"http://a.test/user/{i}/{p}" for i in range(30) for p in ("posts", "likes", "photos", "friends", "about")]
    once, often = templates(spark, addresses), templates(spark, addresses * 5)
    assert {t.split("/")[2] for t, _ in once.values()} == {"{9}"} and once == often


def test_each_family_of_siblings_merges_and_labels_reach_unlabelled_ones(spark):
    flat = [f"http://a.test/{s}/w{i}/" for s in ("fa", "fb", "fc") for i in range(40)]
    deep = [f"http://a.test/{s}/{i}" for s in ("da", "db", "dc") for i in range(30)]
    deep = [f"{a}/{b}" for a in deep for b in ("x", "y")]
    found = templates(spark, flat + deep, [("block", "a.test", "/fa/"), ("allow", "a.test", "/da/")])
    first = {a: found[a][0].split("/")[1] for a in found}
    assert len({first[a] for a in flat}) == 1 and len({first[a] for a in deep}) == 1
    assert {first[flat[0]], first[deep[0]]} == {"{~}", "{~2}"}
    assert {found[a][1] for a in flat} == {"block"} and {found[a][1] for a in deep} == {"allow"}


def test_an_unlabelled_anchor_does_not_join_opposite_labels(spark):
    addresses = [f"http://a.test/{s}/w{i}/" for s, n in (("none", 50), ("bad", 40), ("good", 40)) for i in range(n)]
    found = templates(spark, addresses, [("block", "a.test", "/bad/"), ("allow", "a.test", "/good/")])
    assert found["http://a.test/bad/w1/"][0] != found["http://a.test/good/w1/"][0]


def test_levels_go_on_to_the_last_segment(spark):
    addresses = [f"http://a.test/a/b/c/d/e/f/g/{i}/h/{i + 1}" for i in range(20)]
    assert {t for t, _ in templates(spark, addresses).values()} == {"/a/b/c/d/e/f/g/{9}/h/{9}"}
