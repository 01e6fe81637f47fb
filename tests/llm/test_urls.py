"""Url rules against plain comparison, and the registered query against its SQL twin."""

import random

from compare import duck, mismatch

from rankloom.llm.oracle import LLM_ORACLE
from rankloom.llm.queries import LLM_REGISTRY
from rankloom.llm.urls import RuleTrie, host_and_path, judged

SF = "/root/testdata/sf0.001"


def plain(allow, block, host, path):
    fitting = []
    for verdict, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            h, slash, p = rule.partition("/")
            if ("." + host).endswith("." + h) and path.startswith(slash + p):
                fitting.append((len(rule), len(h), verdict, rule))
    return max(fitting)[2:][::-1] if fitting else None


def test_longest_rule_wins():
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "c.b.a.com", "", "com.a"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/english/", "//", "/en//y", "/e"]
    rules = [h + p for h in hosts[:6] for p in paths]
    for _ in range(200):
        allow, block = rng.sample(rules, 6), rng.sample(rules, 6)
        trie = RuleTrie(allow, block)
        for host in hosts:
            for path in paths:
                got = trie.match(host, path)
                want = plain(allow, block, host, path)
                assert (got and got[1]) == (want and want[1]) and (got is None) == (want is None)


def test_parts():
    assert host_and_path(None) == ("", "")
    assert host_and_path("no scheme") == ("", "")
    assert host_and_path("http://A.Com?x=/y") == ("a.com", "")
    assert host_and_path("a://b://c/d#e") == ("b:", "//c/d")
    assert host_and_path("http://É.com:80/P?q") == ("É.com:80", "/P")


def test_table(spark):
    pages = spark.createDataFrame(
        [(1, "http://www.a.com/en/1", "r"), (2, None, "r"), (2, None, "r"), (None, "x://b.net", "r"), (3, "", "r")],
        "page_id bigint, url string, rule string",
    )
    got = sorted(map(tuple, judged(pages, ["com/"], ["a.com/en/"]).collect()), key=repr)
    assert got == sorted(
        [(1, "www.a.com", "/en/1", "a.com/en/", "block"), (2, "", "", None, "allow"), (2, "", "", None, "allow"),
         (None, "b.net", "", None, "allow"), (3, "", "", None, "allow")], key=repr)
    assert judged(pages.limit(0), [], []).count() == 0


def test_query_equals_its_twin(spark):
    assert mismatch(LLM_REGISTRY["op2_url_filter"](spark, SF).toPandas(), duck(SF).execute(LLM_ORACLE["op2_url_filter"]).df()) is None
