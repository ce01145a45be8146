import random

from quire.llm.queries import URL_RULES
from quire.llm.url_filter import Rule, Trie, filter_urls


def plain(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: r.rank, default=None)


def test_trie_agrees_with_trying_every_rule():
    draw = random.Random(1)
    label = lambda: draw.choice(["a", "b", "org", "com", "x"])
    path = lambda: draw.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c1", "//", "/b/"])
    rules = [Rule(draw.choice(["allow", "block"]), ".".join(label() for _ in range(draw.randint(1, 3))), path()) for _ in range(60)]
    trie = Trie(rules)
    for _ in range(3000):
        host, at = ".".join(label() for _ in range(draw.randint(1, 4))), path() + draw.choice(["", "x", "/y"])
        assert trie.match(host, at) == plain(rules, host, at), (host, at)


def test_every_kind_of_url(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/ES/x", "http://a.Example.org/es/", "http://example.org/en/12?q=1", "http://example.org", "http://x.com/de/a", "http://x.com/fr/#f", "a://b://c/d", "http://example.net/x", "http://notexample.org/es/", "http://example.org/es"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {r.page_id: r for r in filter_urls(df, URL_RULES).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("", "", None, "allow")
    assert (out[3].host, out[3].path) == ("", "")
    assert (out[4].host, out[4].path, out[4].rule, out[4].verdict) == ("example.org", "/ES/x", "org/", "allow")
    assert (out[5].rule, out[5].verdict) == ("example.org/es/", "block")
    assert (out[6].rule, out[6].path) == ("example.org/en/1", "/en/12")
    assert out[7].rule is None  # an empty path doesn't begin with a slash
    assert (out[8].verdict, out[9].rule) == ("block", "com/fr/")
    assert (out[10].host, out[10].path) == ("b:", "//c/d")
    assert out[11].rule is None and out[12].rule == "org/" and out[13].rule == "org/"


def test_many_tries_give_what_one_gives(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 9}.example.org/p{i % 5}/{i}") for i in range(200)], "page_id long, url string")
    rules = [("allow", "org/"), *[("block", f"h{i}.example.org/p{j}") for i in range(9) for j in range(0, 5, 2)]]
    one, many = (filter_urls(df, rules, rules_per_trie=n).orderBy("page_id").collect() for n in (1000, 4))
    assert one == many
    assert filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(df, [], default="block").collect()} == {"block"}
