import numpy as np

from stellate.llm import urls

PAGES = "page_id long, url string, html string, host string, path string"


def test_rules_and_parts(spark):
    rows = [
        (1, "https://a.example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://EXAMPLE.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        (3, "http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        (4, "http://x.example.net/de/8/y", "x.example.net", "/de/8/y", "example.net/de/8", "block"),
        (5, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        (6, "http://x.org?es", "x.org", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme/en/", "", "", None, "allow"),
        (9, "://Ü.com#x", "Ü.com", "", None, "block"),
        (9, "://Ü.com/en/", "Ü.com", "/en/", "com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, u, None, "x", "y") for i, u, *_ in rows], PAGES)
    got = {(r["page_id"], r["path"]): tuple(r) for r in urls.judge_urls(df).collect()}
    for i, _, host, path, rule, verdict in rows:
        assert got[i, path] == (i, host, path, rule, verdict)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_propagation_is_pagerank(spark):
    """Against the solution of the linear system with mass of hosts without links given back to the seeds."""
    rng = np.random.default_rng(1)
    n = 12
    w = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(w, 0)
    w[4] = 0
    edges = [(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
    seeds = [("h0", 3, 0), ("h1", 1, 2), ("h5", 0, 4)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    for k, m in ((0, w.astype(float)), (1, w.T.astype(float))):
        p = np.zeros(n)
        for h, *v in seeds:
            p[int(h[1:])] = v[k]
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        share[m.sum(axis=1) == 0] = p / p.sum()
        r = np.linalg.solve(np.eye(n) - 0.85 * share.T, 0.15 * p)
        assert abs(r.sum() - p.sum()) < 1e-9
        for i in range(n):
            assert abs(got.get(f"h{i}", (0, 0))[k] - r[i]) < 1e-5


def test_a_long_chain_settles(spark):
    """Trust that a fixed ten rounds would not have brought there yet."""
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)]
    got = {r["host"]: r["trust"] for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([("h0", 1, 0)], "host string, trust long, distrust long")).collect()}
    want = np.array([0.85**i for i in range(31)])
    want /= want.sum()
    assert max(abs(got[f"h{i}"] - want[i]) for i in range(31)) < 1e-5


def test_links_that_are_none(spark):
    html = "<!-- <a href='//c.io/'> --><script>x='<a href=\"//s.io\">'</script><style><a href=//t.io></style><a data-href='//d.io/'>x</a><A\nclass=b\nHREF=//Ok.io/x>"
    got = urls.host_edges(spark.createDataFrame([("http://a.io/", html)], "url string, html string")).collect()
    assert [tuple(r) for r in got] == [("a.io", "ok.io", 1)]


def test_links_carry_verdicts(spark):
    rows = [
        (1, "http://bad.com/en/x", ""),
        (2, "http://friend.io/a", '<a class=x href="http://BAD.com/en/y">b</a>'),  # links to a blocked host
        (3, "http://good.net/de/", "<a href='//liked.io/z'>l</a>"),
        (4, "http://liked.io/q", '<a href="/inner">x</a><img href="http://bad.com">'),
        (5, "http://alone.io/q", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
