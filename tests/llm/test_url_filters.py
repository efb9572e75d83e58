import itertools

import pytest
from pyspark.sql import functions as F

import compare
from plumbob.llm import registry
from plumbob.llm import url_filters as U

PAGES, LABELS = "page_id long, url string, html string, host string, n long", "doc_id long, quality int, toxic int, page_id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", 1) for i, u in rows], PAGES)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "y") for r in rows], LABELS)


@pytest.mark.parametrize(
    "url, host, domain, suffix",
    [
        ("http://Blog.Example.com./a?b#c", "blog.example.com", "example.com", "com"),
        ("https://u:p@a.b.co.uk:8080/x", "a.b.co.uk", "b.co.uk", "co.uk"),
        ("http://10.0.0.1/x", "10.0.0.1", "10.0.0.1", "10.0.0.1"),
        ("http://localhost", "localhost", "localhost", "localhost"),
        ("http://co.uk/", "co.uk", "co.uk", "co.uk"),
        ("http://x.shop.com.sg", "x.shop.com.sg", "shop.com.sg", "com.sg"),
        ("http://a.b.co.il", "a.b.co.il", "b.co.il", "co.il"),
        ("http://me.blogspot.com/p", "me.blogspot.com", "me.blogspot.com", "blogspot.com"),
        ("http://a.b.c.ck", "a.b.c.ck", "b.c.ck", "c.ck"),
        ("http://a.www.ck", "a.www.ck", "www.ck", "ck"),
        ("http://x.y.eu-west-1.compute.amazonaws.com", "x.y.eu-west-1.compute.amazonaws.com", "y.eu-west-1.compute.amazonaws.com", "eu-west-1.compute.amazonaws.com"),
        ("http://city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp"),
        ("/relative", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_hosts(spark, url, host, domain, suffix):
    h = U.host_of(F.col("u"))
    s, d = U.parts_of(h)
    row = spark.createDataFrame([(url,)], "u string").select(h.alias("h"), d.alias("d"), s.alias("s")).first()
    assert tuple(row) == (host, domain, suffix)


def test_suffixes_against_the_algorithm(spark):
    """Rules given as data, against the public suffix list's algorithm."""
    rules = ("com", "b.com", "*.uk", "!x.uk", "a.b.c.net", "*.d.net")
    hosts = [".".join(p) for n in (1, 2, 3, 4, 5) for p in itertools.product(["a", "b", "x", "d"], repeat=n - 1) for p in [(*p, t) for t in ("com", "uk", "net")]] + ["q.a.b.c.net", "a.b.c.net", "b.c.net"]

    def suffix(host):
        parts = host.split(".")
        fits = [r for r in rules if len(r.strip("!").split(".")) <= len(parts) and all(x in ("*", y) for x, y in zip(r.strip("!").split(".")[::-1], parts[::-1]))]
        kept = [r for r in fits if r[0] == "!"]
        size = len(kept[0].split(".")) - 1 if kept else max([1, *(len(r.split(".")) for r in fits)])
        return ".".join(parts[-size:]), ".".join(parts[-size - 1 :])

    s, d = U.parts_of(F.col("h"), rules)
    got = {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", s.alias("s"), d.alias("d")).collect()}
    assert got == {h: suffix(h) for h in hosts}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    assert compare.differences(spark, f"/root/testdata/{sf}", U.op8_url_filters, registry.ORACLE_SQL["op8_url_filters"]) == ""


def world(spark):
    """A bad domain with a host of few labels, a good one, and a bad host in a good domain."""
    rows, marks, i = [], [], 0
    for host, n, bad in [("a.bad.org", 60, 55), ("b.bad.org", 60, 54), ("new.bad.org", 2, 2), ("a.good.org", 60, 2), ("b.good.org", 60, 1), ("spam.good.org", 60, 58), ("once.good.org", 1, 1), *((f"h{k}.other{k}.net", 20, k % 3) for k in range(10))]:
        for k in range(n):
            rows.append((i, f"https://{host}/{k}"))
            marks.append((i, 0 if k < bad else 1, 0))
            i += 1
    return pages(spark, rows), labels(spark, marks)


def test_shrinkage(spark, monkeypatch):
    p, l = world(spark)
    kept = {r.host: r.kept for r in U.judged(p, l).collect()}
    assert {h for h, k in kept.items() if not k} >= {"a.bad.org", "b.bad.org", "spam.good.org"}
    assert kept["a.good.org"] and kept["once.good.org"] and all(k for h, k in kept.items() if h.endswith(".net"))
    rep = {r.host: r for r in U.reputation(p, l).collect()}
    assert 0 < rep["once.good.org"].mean < 0.9 and rep["new.bad.org"].mean > rep["once.good.org"].mean
    out = U.filtered(p, l)
    with monkeypatch.context() as m:
        m.setattr(U, "SENT_HOSTS", 0)
        assert sorted(map(repr, U.filtered(p, l).collect())) == sorted(map(repr, out.collect()))
        assert {r.host: r.kept for r in U.judged(p, l).collect()} == kept
    assert out.columns == p.columns and out.count() == sum(r.kept for r in U.judged(p, l).collect())


def test_odd_rows(spark):
    p = pages(spark, [(1, "http://a.com/1"), (1, "http://a.com/1"), (2, None), (None, "http://b.com"), (3, ""), (4, "http://" + "x" * 50_000 + ".com")])
    l = labels(spark, [(1, 0, 1), (1, 1, 0), (None, 0, 0), (2, None, None), (77, 0, 0)])
    got = U.judged(p, l).collect()
    assert len(got) == 6 and {r.n for r in got if r.host == "a.com"} == {1}
    assert all(r.kept and r["mean"] is None for r in got if r.host is None)
    assert all(r.kept for r in U.judged(p, l.limit(0)).collect())
    assert U.judged(p.limit(0), l).count() == 0 and U.filtered(p, l.limit(0)).count() == 6
