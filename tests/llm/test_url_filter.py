"""Url verdicts against plain loops over the rules."""

import random
import re

import duckdb
import pytest

from parlance.llm import queries as Q
from parlance.llm import url_filter


def brute(urls, rules, hosts):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    within = lambda host, top: host == top or host.endswith("." + top)
    out = []
    for k, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [(len(h + p), len(h), v, low(h) + p) for h, p, v in rules if within(host, low(h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((k, host, path, best and best[3], best[2] if best else "block" if any(within(host, h) for h in hosts) else "allow"))
    return sorted(out, key=repr)


AWKWARD = [
    None, "", "no scheme.com/", "://", "://com", "://com/", "http://COM/x", "http://a.com?q=/en/", "http://a.com#/en/", "x://y://example.com/en/", "http://example.com/en/?q#f",
    "http://notexample.com/en/", "http://www.example.com/en/", "http://a.www.example.com/en", "http://a.www.example.com/en/x", "http://.net/es/", "http://net./es/", "http://net/es/",
    "http://u@h.net:80/fr/", "http://x.net/fr/", "http://x.net/Fr/", "http://ÉÀ.net/fr/é", "http://a\nb.com/\n/en/", "http://" + "a." * 3000 + "net/fr/" + "z" * 300_000, "http://..com/", "http://X.Example.COM/en/",
]


@pytest.mark.parametrize("a_pass, words", [(4, 2**21), (32, 64)])
def test_loops(spark, monkeypatch, a_pass, words):
    monkeypatch.setattr(url_filter, "SHAPES_A_PASS", a_pass)
    monkeypatch.setattr(url_filter, "MOST_WORDS", words)
    monkeypatch.setattr(url_filter, "LEAST_WORDS", 1)
    rng = random.Random(a_pass + words)
    name = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))
    rules = list({(name(), path(), rng.choice(["allow", "block"])) for _ in range(25)}) + [("a.B", "", "block"), ("a.b", "", "allow")] + list(url_filter.RULES)
    hosts = [name() + ".e" for _ in range(300 if words == 64 else 20)] + ["y"]
    urls = list(enumerate(AWKWARD)) + [(100 + i % 300, f"h://{name()}{rng.choice(['', '.e', '.y'])}{path()}") for i in range(400)]
    frame = spark.createDataFrame([(k, u, "clash", "clash") for k, u in urls], "page_id long, url string, rule string, best string").repartition(3)
    got = url_filter.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert set(got.columns) == {"page_id", "url", "rule", "best", "host", "path", "verdict"}
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == brute(urls, rules, hosts)


def test_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, none.schema)
    frame = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    assert url_filter.judge_urls(frame.limit(0), rules, none.select("host")).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(frame, none, none.select("host")).collect()] == ["allow"]
    assert [r.rule for r in url_filter.judge_urls(frame, rules, none.select("host")).collect()] == ["net/es/"]


def test_levels_are_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RATE", 1)
    monkeypatch.setattr(url_filter, "LEAST_WORDS", 1)
    F = url_filter.F
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    levels = url_filter.cascade(keys)
    assert len(levels) >= 3
    assert keys.where(url_filter.member(levels, F.col("key")) != F.col("listed")).count() == 0


def test_native_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = Q.op13_url_filter(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(Q.SQL["op13_url_filter"]).select(*df.columns).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)
