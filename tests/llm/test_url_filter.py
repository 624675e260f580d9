import itertools
import random

from footgrid.llm import url_filter as U

RULES = [*U.RULES, ("a.b", "", "block"), ("b", "/x", "allow"), ("a.b", "/x/y", "block"), ("c", "/", "allow"), ("c", "/", "block")]


def judged(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = max(((len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[3], best[2] if best else default


def test_equals_brute_force(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "http://", "http://A.B", "http://a.b?x=://c/", "x://org", "http://C/", "http://é.C/#", "http://example.org/en/12", "http://user@c:80/x"]
    hosts, paths = ["a.b", "q.a.b", "qa.b", "b", "ORG", "www.Example.org", "com", "x.com", "..com", "c", "d.c"], ["", "/", "/x", "/x/y", "/x/yz", "/es/", "/en/1", "/fr/1", "/de/?a", "?x", "#/de/", "//"]
    urls += [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)]
    urls += rng.choices(urls, k=60)
    for rules in (RULES, list(U.RULES), []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        for config in (U.UrlFilter(), U.UrlFilter(broadcast_rules=0)):
            pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, table, config).collect()}
            assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_many_labels_and_empty_table(spark):
    url = "http://" + "a." * 20_000 + "com/fr/" + "z" * 50_000
    pages = spark.createDataFrame([(1, url), (1, url)], "page_id long, url string")
    assert [r.rule for r in U.judge(pages, U.rule_table(spark)).collect()] == ["com/fr/"] * 2
    assert U.judge(pages.where("page_id < 0"), U.rule_table(spark)).count() == 0
