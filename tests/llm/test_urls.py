import re

import numpy as np

from cellweave.llm import queries, urls


def test_propagation_by_matrix(spark):
    rng = np.random.default_rng(4)
    n = 30
    links = {(a, b): int(w) for a, b, w in zip(rng.integers(0, n, 120), rng.integers(0, n, 120), rng.integers(1, 5, 120)) if a != b}
    trusted, blocked = {0, 1, 2}, {3, 4}
    m = np.zeros((n, n))
    for (a, b), w in links.items():
        m[a, b] = w
    out = np.divide(m, m.sum(1, keepdims=True), where=m.sum(1, keepdims=True) > 0, out=np.zeros_like(m))
    back = np.divide(m.T, m.T.sum(1, keepdims=True), where=m.T.sum(1, keepdims=True) > 0, out=np.zeros_like(m))
    t0 = np.array([i in trusted for i in range(n)]) / len(trusted)
    d0 = np.array([i in blocked for i in range(n)]) / len(blocked)
    t, d = t0, d0
    for _ in range(urls.ITERATIONS):
        t, d = (1 - urls.DAMPING) * t0 + urls.DAMPING * t @ out, (1 - urls.DAMPING) * d0 + urls.DAMPING * d @ back
    df = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in links.items()], "src string, dst string, n int")
    seeds = spark.createDataFrame([(f"h{i}", i in trusted, i in blocked) for i in range(n)], "host string, trusted boolean, blocked boolean")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(df, seeds).collect()}
    for i in range(n):
        a, b = got.get(f"h{i}", (0.0, 0.0))
        assert abs(a - t[i]) < 1e-12 and abs(b - d[i]) < 1e-12


def page(i, url, *links):
    return i, url, "".join(f'<p><A class="x" HREF={q}{u}{q}>t</a>' for u, q in zip(links, ['"', "'", ""] * 9)), "x"


def test_verdicts_follow_links(spark):
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("good.org", "/", "allow"), ("good.org", "/spam/", "block")], "host string, path string, verdict string")
    rows = [
        page(1, "http://bad.com/a"), page(2, "http://www.bad.com/a?x"), page(3, "https://good.org/x", "https://friend.io/1"), page(4, "https://a.good.org/spam/1"),
        page(5, "http://friend.io/", "//NEUTRAL.dev/x"), page(6, "http://fan.biz/", "http://bad.com/", "https://www.bad.com/q"), page(7, "http://fanfan.biz", "http://fan.biz"),
        page(8, "http://neutral.dev/"), page(9, "http://far.away/"), page(10, None), page(11, ""), page(12, "nothing"), page(12, "nothing"), page(13, "http://notbad.com/"), page(14, "http://GOOD.org?q"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    assert got == {
        1: ("bad.com", "/a", "bad.com/", "block"), 2: ("www.bad.com", "/a", "bad.com/", "block"), 3: ("good.org", "/x", "good.org/", "allow"),
        4: ("a.good.org", "/spam/1", "good.org/spam/", "block"), 5: ("friend.io", "/", None, "allow"), 6: ("fan.biz", "/", None, "block"),
        7: ("fanfan.biz", "", None, "block"), 8: ("neutral.dev", "/", None, "allow"), 9: ("far.away", "/", None, "allow"), 10: ("", "", None, "allow"),
        11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("notbad.com", "/", None, "allow"), 14: ("good.org", "", None, "allow"),
    }
    assert urls.judge(df, rules).count() == len(rows) and urls.judge(df.limit(0), rules).count() == 0
    assert urls.judge(df, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_main_path_runs_no_python(spark, small):
    plan = queries.QUERIES["op1_urls"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_chains_are_followed_to_their_end(spark):
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("good.org", "/", "allow")], "host string, path string, verdict string")
    rows = [page(0, "http://bad.com/")] + [page(i, f"http://h{i}.net/", f"http://h{i - 1}.net/" if i > 1 else "http://bad.com/") for i in range(1, 31)]
    rows.append(page(99, "http://alone.net/"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string, rule string"), rules).collect()}
    assert got == {i: "block" for i in range(31)} | {99: "allow"}


def test_columns_named_like_the_joined_ones(spark):
    rules = spark.createDataFrame([("bad.com", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://bad.com/", "", "x", 1), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, fits string, n int")
    got = {r["page_id"]: (r["verdict"], r["fits"], r["n"]) for r in urls.judge(df, rules).collect()}
    assert got == {1: ("block", "x", 1), 2: ("allow", None, None)}
