import math
import random
import re
from collections import Counter

import pytest

from relevia.llm import url_filter as U
from relevia.llm.queries import QUERIES, URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    best = None
    for r in URL_RULES:
        own, _, start = r.text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            best = max(best, r, key=lambda x: len(x.text)) if best else r
    return best


ODD = [
    None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.example.org/es/x", "https://example.org/en/1#x", "http://x.org?q=/es/",
    "http://xexample.org/es/", "http://a.com/fr/", "http://a.com/de/", "http://a.com/DE/", "http://com/de/?a=b&c=d", "a://b://c.org/", "http://é.org/ü#1",
    "http://h/" + "x" * 100000, "http://a.org\n/x", "http://user@x.org:80/", "http://x.org:80",
]


def check(rows, got):
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in rows)
    urls = {}
    for i, url in rows:
        urls.setdefault(i, url)
    for r in got:
        host, path = parts(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score > 0.5 else "allow")


def test_parts_and_rules(spark):
    rows = list(enumerate(ODD)) + [(3, ODD[3])]
    pages = spark.createDataFrame([(*r, "h", "x") for r in rows], "page_id long, url string, host string, verdict string")
    check(rows, U.judge_urls(pages, URL_RULES, trees=2).collect())
    assert U.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_one_kind_of_label_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, URL_RULES).collect()} == {1: "allow", 2: "allow"}
    assert {r.verdict for r in U.judge_urls(pages, []).collect()} == {"allow"}


def test_held_out_accuracy(spark):
    draw = random.Random(6)
    rows = []
    for i in range(1500):
        bad = draw.random() < 0.4
        name = "".join(draw.choice("abcdefgh") for _ in range(8))
        host = f"{name}{draw.randrange(10**6)}.{draw.choice(['xyz', 'com'])}" if bad else f"{name}.{draw.choice(['com', 'org'])}"
        rows.append((f"http://{host}/{draw.randrange(99)}" + ("?a=1&b=2&c=3" if bad and draw.random() < 0.5 else ""), int(bad)))
    train = spark.createDataFrame([(u, b) for u, b in rows[:1000]] + [(None, 1), ("x", None)], "url string, blocked int")
    model = U.fit_urls(train)
    host, path = U.url_parts(U.F.col("url"))
    test = spark.createDataFrame(rows[1000:], "url string, blocked int")
    keys = U.suffix_keys(host, path)
    wide = test.select("blocked", *[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in U.lexical_features(U.F.col("url"), host, path).items()])
    scored = model.margin(wide, list(keys)).select("blocked", "margin").collect()
    assert sum((r.margin > 0) == bool(r.blocked) for r in scored) / len(scored) > 0.95


def test_features_by_hand(spark):
    url = "https://www.a-b1.org/x1/y2/?q=1&r=#z"
    row = spark.createDataFrame([(url,)], "url string")
    host, path = U.url_parts(U.F.col("url"))
    got = row.select(*[c.alias(n) for n, c in U.lexical_features(U.F.col("url"), host, path).items()]).first()
    counts = Counter(url)
    assert got.entropy == pytest.approx(-sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()))
    assert (got.depth, got.parameters, got.labels, got.hyphens, got.path_digits) == (3, 2, 3, 1, 2)
    assert got.digit_share == pytest.approx(4 / len(url))


def test_trees_fit_a_known_rule(spark):
    rows = spark.createDataFrame([(a, b, 10, 10 * int((a > 1) != (b > 2))) for a in range(4) for b in range(5)], "a int, b int, n int, y int")
    model = U.grow_trees(rows, ["a", "b"], {"a": [0.0, 1.0, 2.0], "b": [0.0, 1.0, 2.0, 3.0]}, trees=12, depth=2, rate=0.5)
    margin = model.margin({"a": U.F.col("a"), "b": U.F.col("b")})
    assert all((r.m > 0) == ((r.a > 1) != (r.b > 2)) for r in rows.select("a", "b", margin.alias("m")).collect())


def test_op1_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
    result = QUERIES["op1_url_filter"](spark, folder)
    assert "Python" not in result._jdf.queryExecution().toString()
    check(rows, result.collect())
