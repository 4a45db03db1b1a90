import random
import re

import pytest

from pyspark.sql import functions as F

from riskloom.llm import url_rules
from tests.llm.helpers import with_clashes

SCHEMA, RULES = "event_id bigint, page_url string", "host string, path string, verdict string"


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        tail = url[url.index("://") + 3:]
        host = re.match(r"[^/?#]*", tail)[0]
        path = re.match(r"[^?#]*", tail[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    kept = {}
    for h, p, v in rules:
        if h and v in ("allow", "block"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), h), p or ""
            kept[key] = max(v, kept.get(key, ""))
    fits = [(len(h.encode()), len(p.encode()), h + p, v) for (h, p), v in kept.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, rows, rules, **options):
    events = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit("y") for c in ("key", "row", "chunk", "kind", "step", "payload", "top", "host",
                                                                                                     "path", "rule", "verdict", "depth", "local")})
    found = url_rules.judge_events(events, spark.createDataFrame(rules, RULES), **options)
    assert found.columns == ["event_id", "host", "path", "rule", "verdict"]
    return sorted([tuple(r) for r in found.collect()], key=repr)


ODD = [None, "", "no address", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/?x=http://a.net/es/", "http://example.com", "http://example.com?q=/en/",
       "http://example.com#/en/", "http://example.com:80/en/", "http://xexample.com/en/", "http://a.b.example.com/en", "http://example.com/en/\nz", "x\ny://example.com/en/",
       "http://ñandú.example.com/en/ñ", "http://example.com./en/", "http://..com/", "http://net/es/", "http://example.com/EN/", "http://com/" + "x" * 100_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_addresses_and_nested_rules(spark, seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "aa", "com", "net", "ñ"], ["/", "/e", "/en/", "/en/x", "/é", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))      # noqa: E731
    rules = [(host(), "".join(rng.choice(parts) for _ in range(rng.randrange(3))) or None, rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [rules[0], (None, "/", "block"), ("", "/", "block"), ("b.com", "/", "other"), (rules[1][0].upper(), rules[1][1], "block")]
    urls = ODD + [f"http://{host()}{''.join(rng.choice(parts) for _ in range(rng.randrange(5)))}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/en/"), (3, urls[3]), (3, urls[3])]
    expected = sorted([(k, *slow(u, rules)) for k, u in rows], key=repr)
    assert judged(spark, rows, rules) == expected
    assert len({e[3] for e in expected}) > 40


def test_one_address_has_most_rows(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = [(i, "http://www.example.com/en/1") for i in range(3000)] + [(5000 + i, f"http://h{i}.com/") for i in range(500)]
    assert judged(spark, rows, rules) == sorted([(k, *slow(u, rules)) for k, u in rows], key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_without_rules_or_events(spark):
    assert judged(spark, [(1, "http://a.com/x"), (2, None)], [], default="block") == [(1, "a.com", "/x", None, "block"), (2, "", "", None, "block")]
    assert judged(spark, [], [("com", "/", "block")]) == []


def test_no_python_in_the_plan(spark):
    events = spark.createDataFrame([(1, "http://a.com/x")], SCHEMA)
    plan = url_rules.judge_events(events, spark.createDataFrame([("com", "/", "block")], RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
