"""URL rules and host reputation against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from ticklake.llm import url_reputation as u

PAGES = "page_id long, url string, html string, host string, n int"
URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2?x=/fr/", "http://WWW.Example.COM/EN/3", "http://example.com",
    "http://example.com?x", "http://x.net/es/1", "ftp://x.net/fr", "http://x.net/fr/#a", "http://notexample.com/en/1", None, "",
    "no scheme", "http://", "http:///path", "http://com/", "http://a.com/b://c.net/es/", "x\ny://Q.ORG\n/z", "http://É.net/es/",
    "http://x.org:8080/en/5.html", "http://x.org/en/5/", "http://net/fr/", "http://.net/es/",
]


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group(1)) if m else ""
    path = m.group(2) if m else ""
    best = None
    for verdict, rule in u.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules(spark):
    pages = spark.createDataFrame([(i, x, "h", "clash", 1) for i, x in enumerate(URLS * 2)], PAGES)
    none = spark.createDataFrame([], "url string, bad int")
    rows = u.judge(pages, none).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, best = plain((URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "allow")


def test_empty(spark):
    pages = spark.createDataFrame([], PAGES)
    assert u.judge(pages, spark.createDataFrame([], "url string, bad int")).count() == 0


def rates(units):
    k, n, b = len(units), sum(x for x, _ in units), sum(y for _, y in units)
    if k < 2 or n <= k:
        return u.STRONGEST
    sq = sum(int(y * y / x * 1e6) for x, y in units) / 1e6
    between, within = (sq - b * b / n) / (k - 1), (b - sq) / (n - k)
    spread = (n - sum(x * x for x, _ in units) / n) / (k - 1)
    if between <= within:
        return u.STRONGEST
    return min(max((between + (spread - 1) * within) / (between - within) - 1, u.WEAKEST), u.STRONGEST)


def test_reputation_shrinks_towards_the_domain(spark):
    counts = {"a.bad.org": (50, 48), "b.bad.org": (40, 39), "c.bad.org": (0, 0), "a.good.org": (60, 1), "b.good.org": (1, 1),
              "x.net": (10, 2), "y.net": (12, 1), "": (0, 0)}
    hosts = spark.createDataFrame([(h, n, b) for h, (n, b) in counts.items()], "host string, n long, b long")
    got = {r.host: (r["mean"], r.bound) for r in u.reputation(hosts).collect()}
    domain = {h: ".".join(h.split(".")[-2:]) for h in counts}
    suffix = {h: h.split(".")[-1] for h in counts}

    def level(names):
        total = {}
        for h, (n, b) in counts.items():
            x, y = total.get(names[h], (0, 0))
            total[names[h]] = (x + n, y + b)
        return total, rates([v for v in total.values() if v[0]])

    n_all, b_all = sum(n for n, _ in counts.values()), sum(b for _, b in counts.values())
    by_suffix, k = level(suffix)
    s_mean = {x: (b + k * (b_all + 1) / (n_all + 2)) / (n + k) for x, (n, b) in by_suffix.items()}
    by_domain, k = level(domain)
    d_mean = {domain[h]: (by_domain[domain[h]][1] + k * s_mean[suffix[h]]) / (by_domain[domain[h]][0] + k) for h in counts}
    k = rates([v for v in counts.values() if v[0]])
    for h, (n, b) in counts.items():
        mean = (b + k * d_mean[domain[h]]) / (n + k)
        bound = mean - u.DEVIATIONS * (mean * (1 - mean) / (n + k + 1)) ** 0.5
        assert got[h] == pytest.approx((mean, bound), rel=1e-9)
    assert got["c.bad.org"][0] > 0.5 > got["b.good.org"][0]


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{h}.org/{i}") for i, h in enumerate(["bad.x"] * 40 + ["good.y"] * 40)], "page_id long, url string")
    outcomes = pages.select("url", F.col("url").contains("bad").cast("int").alias("bad")).union(
        spark.createDataFrame([("http://good.y.org/1", None)], "url string, bad int")
    )
    got = {(r.host, r.verdict, r.judged_by) for r in u.judge(pages, outcomes).collect()}
    assert got == {("bad.x.org", "block", "reputation"), ("good.y.org", "allow", "reputation")}


def test_labels_by_document_number(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/17?x"), (2, "http://a.org/18.html"), (3, "http://a.org/19/"), (4, None),
                                   (5, "http://a.org/x20"), (6, "http://a.org/17")], "page_id long, url string")
    labels = spark.createDataFrame([(17, 1, 0), (17, 0, 0), (18, 1, 1), (19, 1, None), (20, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.url, r.bad) for r in u.labelled_outcomes(pages, labels).collect())
    assert got == [("http://a.org/17", 1), ("http://a.org/18.html", 1), ("http://a.org/19/", 0), ("http://a.org/en/17?x", 1)]
