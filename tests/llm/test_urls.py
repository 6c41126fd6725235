import pytest
from pyspark.sql import functions as F

from metertide.llm.urls import (
    fitting_rule,
    host_and_path,
    host_reputation,
    judge_urls,
)

URLS = [
    (1, "https://WWW.Example.com/en/1?x=/de/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "http://example.com/en/2#a", "example.com", "/en/2", "example.com/en/", "block"),
    (3, "http://a.b.example.com/en/", "a.b.example.com", "/en/", "example.com/en/", "block"),
    (4, "http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    (5, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (6, "ftp://x.net/fr/y", "x.net", "/fr/y", "net/fr/", "block"),
    (7, "x://y.net/es/", "y.net", "/es/", "net/es/", "block"),
    (8, "http://example.com", "example.com", "", None, None),
    (9, "http://example.com?/en/", "example.com", "", None, None),
    (10, "no scheme", "", "", None, None),
    (11, None, "", "", None, None),
    (12, "", "", "", None, None),
    (13, "http:///en/", "", "/en/", None, None),
    (14, "a://b://c/d", "b:", "//c/d", None, None),
    (15, "http://ÀB.org/\nen/", "Àb.org", "/\nen/", None, None),
    (15, "http://ÀB.org/\nen/", "Àb.org", "/\nen/", None, None),
    (None, "http://net/fr/", "net", "/fr/", "net/fr/", "block"),
]


def pages(spark):
    rows = [(k, u, "<html>", "clash", "clash") for k, u, *_ in URLS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, bad string")


def test_hosts_paths_and_rules(spark):
    found = judge_urls(pages(spark)).collect()
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in found)
    assert got == sorted((str(k), h, p, str(r)) for k, _, h, p, r, _ in URLS)
    verdicts = {r["page_id"]: r["verdict"] for r in found}
    assert all(verdicts[k] == v for k, *_, v in URLS if v)
    assert set(verdicts.values()) <= {"allow", "block"}


def test_of_equally_long_rules_the_first_wins(spark):
    df = spark.createDataFrame([("b.a.com", "/x/y")], "host string, path string")
    rules = (("a.com", "/x/", "allow"), ("b.a.com", "/", "block"), ("com", "/x/y", "allow"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    assert tuple(df.select(rule, verdict).first()) == ("a.com/x/", "allow")


def test_few_labels_are_shrunk_to_the_domain(spark):
    rows = [("a.bad.org", 1)] * 300 + [("b.bad.org", 1), ("c.bad.org", 0)] + [("x.good.org", 0)] * 300
    rows += [("y.good.org", 1)] + [(f"h{i}.mixed.org", i % 2) for i in range(40)] + [("new.net", None)]
    labelled = spark.createDataFrame(rows, "host string, bad int")
    found = {r["host"]: r for r in host_reputation(labelled).collect()}
    assert found["a.bad.org"]["lower"] > 0.5
    assert found["b.bad.org"]["mean"] > found["y.good.org"]["mean"]
    assert found["x.good.org"]["mean"] < 0.1
    assert found["new.net"]["labelled_pages"] == 0
    assert found["new.net"]["lower"] < 0.5
    for r in found.values():
        assert 0 <= r["mean"] <= 1
        assert r["lower"] <= r["mean"]


def test_one_label_more_never_lowers_the_mean(spark):
    means = []
    for bad in range(4):
        rows = [("h.a.org", int(i < bad)) for i in range(4)] + [("k.b.org", 1), ("l.b.org", 0)]
        found = host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()
        means.append({r["host"]: r["mean"] for r in found}["h.a.org"])
    assert means == sorted(means)


def test_without_labels_nothing_is_blocked(spark):
    rows = [(i, f"http://h{i}.org/") for i in range(5)]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["verdict"] for r in found} == {"allow"}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("url", ["http://" + "a." * 5000 + "com/", "http://x/" + "y" * 100_000])
def test_very_long_urls(spark, url):
    row = judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    host, path = host_and_path(F.lit(url))
    assert row["host"] == spark.range(1).select(host).first()[0]
    assert len(row["host"]) + len(row["path"]) + 7 == len(url)
