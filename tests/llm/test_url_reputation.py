import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import url_reputation as u

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, x, "<p>") for i, x in enumerate(urls)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS bad", "3 AS n")


NONE = "doc_id long, quality int, toxic int"


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "com/en/", "block"), ("https://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), ("http://example.net/de/8#f", "example.net", "/de/8", "example.net/de/8", "block"), ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("http://org/es/", "org", "/es/", "org/es/", "block"), ("http://x.org/ES/", "x.org", "/ES/", None, "allow"), ("x.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://com?/en/", "com", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://É.COM/en/", "É.com", "/en/", "com/en/", "block"), ("http://x.com/e\nn/", "x.com", "/e\nn/", None, "allow"), ("", "", "", None, "allow"),
    ]
    got = u.filter_urls(pages(spark, [c[0] for c in cases]), spark.createDataFrame([], NONE), RULES)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(i, *c[1:]) for i, c in enumerate(cases)]
    assert u.filter_urls(pages(spark, ["x"]).limit(0), spark.createDataFrame([], NONE), RULES).count() == 0


def test_bad_hosts_are_blocked(spark):
    rng = np.random.default_rng(1)
    urls, labels = [], []
    for i in range(3000):
        host = f"h{i % 30}.site{i % 10}.{'com' if i % 2 else 'org'}"
        urls.append(f"http://{host}/x/{i}")
        bad = rng.random() < (0.9 if i % 30 == 3 else 0.1)
        labels.append((i, 0 if bad else 1, 0))
    labels += [(5, None, None), (None, 0, 1), (7, 1, 1)]
    urls.append("http://few.site1.com/x/3")  # one bad page alone blocks nothing
    got = u.filter_urls(pages(spark, urls), spark.createDataFrame(labels, NONE), [])
    blocked = {r.host for r in got.where("verdict = 'block'").select("host").distinct().collect()}
    assert blocked == {"h3.site3.com"}
    assert got.count() == len(urls)


def test_long_urls(spark):
    urls = ["http://" + "a" * 200_000, "http://" + "a." * 100_000 + "org/es/1", "x" * 300_000, "http://h.org/" + "9" * 300_000]
    got = u.filter_urls(pages(spark, urls), spark.createDataFrame([], NONE), RULES).collect()
    assert {r.page_id: r.rule for r in got} == {0: None, 1: "org/es/", 2: None, 3: None}


def test_posterior_bound(spark):
    rng = np.random.default_rng(2)
    for a, b in ((0.7, 3.0), (2.0, 2.0), (30.0, 10.0), (400.0, 900.0)):
        got = spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b")).select(F.expr(u.lower_bound_sql("a", "b"))).first()[0]
        assert abs(got - np.quantile(rng.beta(a, b, 400_000), 0.05)) < 0.02


def test_domains(spark):
    hosts = {"a.b.example.com": "example.com", "example.co.uk": "example.co.uk", "x.y.co.uk": "y.co.uk", "10.0.0.1:80": "10.0.0.1", "u@h.org:8": "h.org", "localhost": "localhost", "": ""}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", F.expr(u.domain_sql("host")).alias("d"))
    assert {r.host: r.d for r in df.collect()} == hosts


def brute(urls, labels):
    """Bad pages, posterior bound and verdict of each host, in plain Python."""
    bad_doc = {}
    for d, q, t in labels:
        if d is not None and (q is not None or t is not None):
            bad_doc[d] = max(bad_doc.get(d, 0), int(q == 0 or t == 1))
    seen = defaultdict(lambda: [0, 0])
    for x in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", x or "")
        host = m[1].lower() if m else ""
        number = re.search(r"/([0-9]{1,18})(?:\.[A-Za-z0-9]{1,16})?/?$", m[2]) if m else None
        doc = int(number[1]) if number else None
        seen[host][0] += doc in bad_doc
        seen[host][1] += bad_doc.get(doc, 0)
    cut = lambda host, n: ".".join(host.split(".")[-n:])
    groups = lambda n: {c: [sum(seen[h][i] for h in seen if cut(h, n) == c) for i in (0, 1)] for c in {cut(h, n) for h in seen}}
    n, bad = (sum(v[i] for v in seen.values()) for i in (0, 1))
    base = (bad + 0.5) / (n + 1)
    means = {"": base}
    for level, up in ((groups(1), lambda c: ""), (groups(2), lambda c: cut(c, 1)), (dict(seen), lambda c: cut(c, 2))):
        used = [(m, b, means[up(c)]) for c, (m, b) in level.items() if m]
        room = sum(m - 1 for m, _, _ in used)
        spread = (sum(m * (b / m - mu) ** 2 / (mu * (1 - mu)) for m, b, mu in used) - len(used)) / room if room else 0
        k = 1 / min(max(spread, 1e-4), 0.5) - 1
        prior = means
        means = {c: (b + k * prior[up(c)]) / (m + k) for c, (m, b) in level.items()}
    out = {}
    for h, (m, b) in seen.items():
        mu = prior[cut(h, 2)]
        a_, b_ = b + k * mu + 1e-6, m - b + k * (1 - mu) + 1e-6
        # log-odds of Beta(a, b): mean and variance by sums to a large number, then the leading terms
        psi = lambda x: math.log(x + 400) - 1 / (2 * (x + 400)) - sum(1 / (x + i) for i in range(400))
        psi1 = lambda x: 1 / (x + 400) + 1 / (2 * (x + 400) ** 2) + sum(1 / (x + i) ** 2 for i in range(400))
        low = psi(a_) - psi(b_) - 1.6449 * math.sqrt(psi1(a_) + psi1(b_))
        bound = 1 / (1 + math.exp(-low))
        out[h] = (m, b, bound, "block" if bound > base else "allow")
    return out


def test_equals_brute_force(spark, sf):
    """Shrinkage, bound and verdict of every host, on the given pages and on hosts that differ much."""
    rng = np.random.default_rng(8)
    urls = [f"https://h{i % 17}.s{i % 5}.{('com', 'org', 'net')[i % 3]}/a/{i}" for i in range(2000)] + ["http://h1.s1.org/a/1", "x", None]
    labels = [(i, int(rng.random() > 0.05 + 0.5 * (i % 17 == 3) + 0.2 * (i % 3 == 0)), int(rng.random() < 0.03)) for i in range(0, 2000, 2)] + [(4, 0, 0), (6, None, None), (None, 0, 1)]
    real = [(r.url,) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    known = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    decided = 0
    for u_, l_ in ((urls, labels), ([x for x, in real], known)):
        got = u.filter_urls(pages(spark, u_), spark.createDataFrame(l_, NONE), []).collect()
        want = brute(u_, l_)
        assert len(got) == len(u_) and {r.host for r in got} == set(want)
        for r in got:
            n, bad, bound, verdict = want[r.host]
            assert (r.host_labelled, r.host_bad, r.verdict) == (n, bad, verdict) and abs(r.bound - bound) < 1e-4
        decided += sum(r.verdict == "block" for r in got)
    assert decided > 50


def test_repeated_pages_ties_and_other_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/es/1")] * 3 + [(None, None)], "page_id long, url string").selectExpr("*", "1 AS path", "2 AS rule", "3 AS shown", "4 AS action", "5 AS bound", "6 AS m")
    got = u.filter_urls(df, spark.createDataFrame([(1, 0, 0)], NONE), [("allow", "org/es/"), ("block", "org/es/")]).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got if r.page_id) == [(1, "org/es/", "block")] * 3 and len(got) == 4
    (tmp_path / "suffixes.txt").write_text("// comment\nco.nz\n*.ck\n!www.ck\ncom\n co.za \n\n")
    double = u.read_suffixes(spark, f"file://{tmp_path}/suffixes.txt")
    assert double == ["co.nz", "co.za"]
    assert spark.range(1).select(F.expr(u.domain_sql("'x.y.co.nz'", double)), F.expr(u.suffix_sql("'x.y.co.uk'", double))).first()[:] == ("y.co.nz", "uk")
