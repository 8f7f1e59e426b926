import re
from urllib.parse import urlsplit

from geneloom.llm import url_filter as U
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, same

URLS = [
    "http://example.com/de/1", "http://sub.example.com/de/", "http://example.com/en/", "http://notexample.com/de/", "https://A.Example.NET/en/x", "http://x.net/", "http://x.net", "http://a.org/fr/1?x#y",
    "http://spam-farm.example.org/en/1", "http://x.org/adult/1", "http://x.org/adults/1", "http://x.org/?utm_campaign=ads", "http://x.org/?utm_campaign=adsx", "no scheme", "", None, "://", "http://", "ftp://h?q://x/de/",
    "http://host#frag/x", "a://b://c/d", "http://x.org/login.php", "http://x.org/adult\nx", "http://net/", "http://x.org/" + "a" * 50_000,
]


def brute(url):
    text = url or ""
    i = text.find("://")
    rest = text[i + 3 :] if i >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p), h + p, v) for v, h, p in U.DOMAIN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if url is not None and any(re.search(p, url) for p, _ in U.PATTERN_RULES) else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "r", "v", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict string, id int")


def test_matches_brute_force(spark):
    found = U.judge_urls(pages(spark, URLS)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == [brute(u) for u in URLS]


def test_hosts_agree_with_the_standard_library(spark):
    good = [u for u in URLS if u and u.startswith("http://") and "\n" not in u]
    found = {r["page_id"]: r["host"] for r in U.judge_urls(pages(spark, good)).collect()}
    assert [found[i] for i in range(len(good))] == [urlsplit(u).netloc.lower() for u in good]


def test_index_takes_the_rarest_literal():
    rules = (U.Rule("a.*b", ("aa", "bb")), U.Rule("c", ("cc",)), U.Rule("d", ()), U.Rule("e", ("aa",)))
    assert U.rule_index(rules, {"aa": 5, "bb": 1}) == {"": ["d"], "aa": ["e"], "bb": ["a.*b"], "cc": ["c"]}


def test_rules_without_literals_and_literals_without_match(spark):
    rules = ((r"\d{4}", ()), (r"evil$", ("evil",)))
    found = U.judge_urls(pages(spark, ["http://a.org/2024", "http://a.org/evil", "http://a.org/evil/x", "http://a.org/devil", None]), (), rules).orderBy("page_id").collect()
    assert [r["verdict"] for r in found] == ["block", "block", "allow", "allow", "allow"]


def test_long_lists_of_rules_as_tables(spark, monkeypatch):
    """Above MAX_RULES the same verdicts come from joins, and of rules of equal length the same one wins."""
    urls = [*URLS, *URLS, "http://m7.example/x/1", "http://a.m7.example/x", "http://am7.example/x", "http://h9.t/p"]
    domains = (*U.DOMAIN_RULES, *(("block" if i % 2 else "allow", f"m{i}.example", "/x" if i % 3 else "") for i in range(40)), ("allow", "9.t", "/p"), ("block", "h9.t", "/"))
    patterns = (*U.PATTERN_RULES, (r"\d{4}", ()), *((rf"/nothing{i}$", (f"nothing{i}",)) for i in range(40)))
    expected = U.judge_urls(pages(spark, urls), domains, patterns).orderBy("page_id").collect()
    monkeypatch.setattr(U, "MAX_RULES", 10)
    found = U.judge_urls(pages(spark, urls), domains, patterns)
    assert found.orderBy("page_id").collect() == expected
    assert {r["rule"] for r in expected} >= {"m7.example/x", "net/", None}
    plain = U.judge_urls(pages(spark, urls)).orderBy("page_id").collect()
    monkeypatch.setattr(U, "MAX_RULES", 1)
    assert U.judge_urls(pages(spark, urls)).orderBy("page_id").collect() == plain


def test_plan_has_no_python_and_no_shuffle(spark, capsys):
    U.judge_urls(pages(spark, URLS)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table_and_repeated_rows(spark):
    assert U.judge_urls(pages(spark, [])).collect() == []
    twice = pages(spark, ["http://x.net/a"]).union(pages(spark, ["http://x.net/a"]))
    assert [r["verdict"] for r in U.judge_urls(twice).collect()] == ["block", "block"]


def test_query_matches_sql(spark):
    same(QUERIES["op10_url_filters"](spark, DATA), connect(), ORACLE_SQL["op10_url_filters"])
