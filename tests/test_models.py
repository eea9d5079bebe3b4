import math
from decimal import Decimal, getcontext
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions import special
from cellweave.functions.special import t_two_sided_values
from cellweave.operators import de, factorize, interactions, ranks, states, stats
from cellweave.session import cut_lineage


def typed_cells(spark, n, types, samples=1):
    return spark.createDataFrame(
        [(f"S{i % samples}", i, float(i), 0.0, types[i % len(types)]) for i in range(n)],
        "sample_id string, cell_id long, x double, y double, cell_type string",
    )


def long_counts(spark, y, samples=1):
    rows = [(f"S{i % samples}", int(i), f"g{j:03d}", int(y[i, j])) for i, j in zip(*np.nonzero(y))]
    return spark.createDataFrame(rows, "sample_id string, cell_id long, gene string, count long")


def avg_rank(v):
    return pd.Series(v).rank(method="average").to_numpy()


def irls(x, y):
    b = np.array([math.log(y.mean()), 0.0])
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(200):
        mu = np.exp(design @ b)
        step = np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y - mu))
        b = b + step
        if np.abs(step).max() < 1e-13:
            break
    return b[0], b[1], 1 / math.sqrt((np.exp(design @ b) * x * x).sum())


def test_glm_matches_irls_on_simulated_counts(spark):
    rng = np.random.default_rng(0)
    n, g = 300, 40
    load = rng.lognormal(0, 1, n)
    x = np.log(load)
    x = (x - x.mean()) / x.std()
    y = rng.poisson(np.exp(rng.normal(0.5, 0.5, g) + np.outer(x, rng.normal(0, 0.4, g))))
    y[:, 0] = 0
    y[np.argmax(x), 0] = 5  # all counts at the greatest covariate: no estimate exists
    cells = typed_cells(spark, n, ["T"])
    loadings = spark.createDataFrame([("S0", i, 0, float(v)) for i, v in enumerate(load)], "sample_id string, cell_id long, motif int, loading double")
    fits = {r.gene: r for r in de.poisson_glm(stats.covariates(loadings, cells), long_counts(spark, y), tile=16).collect()}
    assert len(fits) == g and not fits["g000"].converged and fits["g000"].logfc is None
    for j in range(1, g):
        b0, b1, se = irls(x, y[:, j].astype(float))
        r = fits[f"g{j:03d}"]
        assert r.converged
        assert (r.intercept, r.logfc, r.se) == pytest.approx((b0, b1, se), abs=1e-9)
        assert r.pval == pytest.approx(math.erfc(abs(b1 / se) / math.sqrt(2)), abs=1e-12)


def test_spearman_matches_dense_ranks(spark):
    rng = np.random.default_rng(1)
    n, g = 90, 12
    y = rng.poisson(0.7, (n, g))
    y[:, 3] = 2
    load = np.round(rng.lognormal(0, 1, (n, 2)), 1)
    load[0, 0] = 0.0  # unusable loading
    cells = typed_cells(spark, n, ["A", "B"])
    loadings = spark.createDataFrame(
        [("S0", i, k, float(load[i, k])) for i in range(n) for k in range(2)], "sample_id string, cell_id long, motif int, loading double"
    )
    got = {(r.motif, r.cell_type, r.gene): r for r in stats.spearman(stats.covariates(loadings, cells), long_counts(spark, y)).collect()}
    for k in range(2):
        for t in range(2):
            use = [i for i in range(n) if i % 2 == t and load[i, k] > 0]
            rx = avg_rank(load[use, k])
            for j in range(g):
                if y[use, j].max() == 0:
                    assert (k, "AB"[t], f"g{j:03d}") not in got
                    continue
                ry = avg_rank(y[use, j])
                rho = 0.0 if ry.std() == 0 else np.corrcoef(rx, ry)[0, 1]
                r = got[(k, "AB"[t], f"g{j:03d}")]
                assert r.rho == pytest.approx(rho, abs=1e-12) and r.n == len(use)
                tt = rho * math.sqrt((len(use) - 2) / (1 - rho * rho + 1e-10))
                assert r.pval == pytest.approx(special.t_two_sided_values([tt], [len(use) - 2])[0], abs=1e-12)


def test_tails():
    # Known values: t with 1 and 2 degrees of freedom have closed forms.
    for t in (0.3, 1.0, 7.5):
        got = special.t_two_sided_values([t, t], [1, 2])
        assert got[0] == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-13)
        assert got[1] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-13)
    near = special.t_two_sided_values([2.2, 2.2], [499.999, 500])
    assert near[0] == pytest.approx(near[1], abs=1e-7)


def test_digamma_and_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 3.7, 250.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", special.digamma(F.col("x")).alias("d"), special.log_gamma(F.col("x")).alias("l")).collect()
    for r in rows:
        h = 1e-5 * r.x
        assert r.l == pytest.approx(math.lgamma(r.x), abs=1e-10)
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-5)
    assert rows[2].d == pytest.approx(-0.5772156649015329, abs=1e-11)


def dense_mwu(a, b):
    r = avg_rank(np.concatenate([a, b]))
    n1, n2 = len(a), len(b)
    u1 = r[:n1].sum() - n1 * (n1 + 1) / 2
    n = n1 + n2
    _, t = np.unique(np.concatenate([a, b]), return_counts=True)
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s
    return u1, min(1.0, math.erfc(z / math.sqrt(2)))


@pytest.mark.parametrize("subsample", [None, 10_000])
def test_differential_expression_matches_dense_test(spark, subsample):
    rng = np.random.default_rng(2)
    n, g = 150, 8
    y = rng.poisson(0.6, (n, g))
    y[::3, 2] += 3
    y[:, 5] = 0
    y[::3, 5] = 1  # never expressed in the control group of type A
    cells = typed_cells(spark, n, ["A", "B", "C"])
    got = {(r.cell_type, r.gene): r for r in stats.differential_expression(cells, long_counts(spark, y), subsample=subsample).collect()}
    for t in range(3):
        inside = np.arange(n) % 3 == t
        for j in range(g):
            r = got[("ABC"[t], f"g{j:03d}")]
            if (y[~inside, j] > 0).mean() < 1e-4:
                assert not r.tested and r.pval == 1.0 and r.log2fc == 0.0
                continue
            u1, p = dense_mwu(y[inside, j], y[~inside, j])
            assert r.u1 == u1 and r.pval == pytest.approx(p, abs=1e-12)
            lfc = math.log2(max(y[inside, j].mean(), 1e-300)) - math.log2(max(y[~inside, j].mean(), 1e-300))
            assert r.log2fc == pytest.approx(lfc, abs=1e-9)
    markers = {(r.cell_type, r.gene) for r in stats.marker_genes(stats.differential_expression(cells, long_counts(spark, y))).collect()}
    assert ("A", "g002") in markers and not any(c == "B" for c, _ in markers)


def test_exact_mwu_enumerates():
    from itertools import combinations

    n1, n2 = 3, 5
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in (8, 11, 15):
        want = min(1.0, 2 * sum(v >= u for v in us) / len(us))
        assert stats._exact_mwu(pd.Series([float(u)]), pd.Series([n1]), pd.Series([n2]))[0] == pytest.approx(want)


def test_ranks_and_samples_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=600), 2)
    v[:200] = 0.5  # a third of the rows share one value
    rows = [("hot" if i < 400 else f"k{i % 7}", i, float(a)) for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "grp string, cell_id long, v double")
    got = {r.cell_id: r["rank"] for r in ranks.rank_rows(df, ["grp"], "v").collect()}
    for key in {r[0] for r in rows}:
        ids = [r[1] for r in rows if r[0] == key]
        for i, want in zip(ids, avg_rank(v[ids])):
            assert got[i] == want
    drawn = ranks.sample_group(df, ["grp"], 50, ["cell_id"], seed=1)
    sizes = {r.grp: r["count"] for r in drawn.groupBy("grp").count().collect()}
    assert sizes["hot"] == 50 and all(n <= 50 for n in sizes.values())
    assert sorted(r.cell_id for r in drawn.collect()) == sorted(r.cell_id for r in ranks.sample_group(df, ["grp"], 50, ["cell_id"], seed=1).collect())
    assert drawn.select("cell_id").distinct().count() == drawn.count()


def test_mixture_finds_modes_and_handles_constant_motifs(spark):
    rng = np.random.default_rng(4)
    high = rng.random(500) < 0.3
    load = np.exp(np.where(high, rng.normal(3, 0.3, 500), rng.normal(-1, 0.5, 500)))
    rows = [("S", i, 0, float(a)) for i, a in enumerate(load)] + [("S", i, 1, 2.0) for i in range(500)]
    loadings = spark.createDataFrame(rows, "sample_id string, cell_id long, motif int, loading double")
    params, flat = states.fit_mixture(loadings)
    got = states.assign_states(loadings, params, flat).collect()
    assert len(got) == 1000
    assert all((r.state == "positive") == bool(high[r.cell_id]) for r in got if r.motif == 0)
    assert all(r.state == "negative" for r in got if r.motif == 1)
    s = {r.motif: r for r in states.mixture_summary(params, flat).collect()}
    assert s[0].mean1 == pytest.approx(3, abs=0.1) and s[0].weight1 == pytest.approx(high.mean(), abs=0.02)
    assert (s[1].weight0, s[1].weight1) == (1.0, 0.0)


def counts_table(spark, y):
    rows = [("S", int(i), int(j), int(y[i, j])) for i, j in zip(*np.nonzero(y))]
    return spark.createDataFrame(rows, "sample_id string, region_id long, lri_idx int, value long")


def test_factorization_recovers_blocks_and_projects(spark):
    rng = np.random.default_rng(5)
    w, v = np.zeros((40, 2)), np.zeros((2, 12))
    w[:20, 0], w[20:39, 1] = 3, 4  # the last region stays empty
    v[0, :6], v[1, 6:] = 2, 2
    y = rng.poisson(w @ v)
    rows = spark.range(40).selectExpr("'S' AS sample_id", "id AS region_id")
    cols = spark.range(12).selectExpr("CAST(id AS INT) AS lri_idx")
    model = factorize.fit(counts_table(spark, y), rows, cols, 2, 12, tol=-1.0, seed=3)
    bounds = [h[1] for h in model.history]
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(bounds, bounds[1:]))
    found = {}
    for r in model.row_loadings().collect():
        found.setdefault(r.region_id, [0, 0])[r.motif] = r.loading
    best = [int(np.argmax(found[i])) for i in range(39)]
    assert len(set(best[:20])) == 1 and len(set(best[20:])) == 1 and best[0] != best[-1]
    empty = model.rows.where("region_id = 39").first()
    assert (empty.shape0, empty.shape1) == (model.alpha, model.alpha)
    cells = rows.withColumnRenamed("region_id", "cell_id")
    got = factorize.project(counts_table(spark, y), model, cells, 60, tol=1e-12)
    again = factorize.project(counts_table(spark, y).where("region_id = 7"), model, cells.where("cell_id = 7"), 60, tol=1e-12)
    alone = {r.motif: r.loading for r in again.collect()}
    # Factors too many to broadcast take the join path, with the same results.
    joined = factorize.project(counts_table(spark, y), model, cells, 60, tol=1e-12, broadcast_rows=3)
    by_join = {(r.cell_id, r.motif): r.loading for r in joined.collect()}
    again = factorize.fit(counts_table(spark, y), rows, cols, 2, 12, tol=-1.0, seed=3, broadcast_rows=3)
    assert [h[1] for h in again.history] == pytest.approx(bounds, rel=1e-12)
    proj = {}
    for r in got.collect():
        assert r.loading == pytest.approx(by_join[r.cell_id, r.motif], rel=1e-12)
        proj.setdefault(r.cell_id, [0, 0])[r.motif] = r.loading
        if r.cell_id == 7:
            assert r.loading == pytest.approx(alone[r.motif], rel=1e-12)
    assert [int(np.argmax(proj[i])) for i in range(39)] == best and len(proj) == 40


def test_thinning_is_binomial_and_repeatable(spark):
    y = np.full((400, 2), 10)
    y[:, 1] = 100
    m = counts_table(spark, y)
    n = m.agg(F.countDistinct("region_id").alias("n_regions"))
    p = factorize.thin_probabilities(m, n, 0.0)
    assert {r.lri_idx: r.p for r in p.collect()} == {0: 1.0, 1: 0.1}
    drawn = factorize.thin(m, p, ["sample_id", "region_id"], 9)
    mean = {r.lri_idx: r.m for r in drawn.groupBy("lri_idx").agg((F.sum("value") / 400).alias("m")).collect()}
    assert mean[0] == 10 and mean[1] == pytest.approx(10, abs=0.5)
    key = lambda d: sorted((r.region_id, r.lri_idx, r.value) for r in d.collect())
    assert key(drawn) == key(factorize.thin(m.repartition(3), p, ["sample_id", "region_id"], 9))


def test_bh_matches_definition(spark):
    p = [0.001, 0.01, 0.01, 0.2, 0.9, 0.04]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(p)], "motif int, g int, pval double")
    got = {r.g: r.qval for r in stats.benjamini_hochberg(df, ["motif"]).collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    assert [got[int(i)] for i in order] == pytest.approx(np.minimum(1, q).tolist())


@pytest.mark.parametrize("v", [2, 4, 100, 498, 500, 502, 5000])
def test_t_tail_against_the_finite_series(v):
    """Closed form for even degrees of freedom in exact decimals, far tails included."""
    getcontext().prec = 120
    for t in (0.0, 0.3, 2.0, 9.0, 30.0):
        t2 = Decimal(t) * Decimal(t)
        y, c, total = v / (v + t2), Decimal(1), Decimal(0)
        for j in range(v // 2):
            total += c * y**j
            c *= Decimal(2 * j + 1) / Decimal(2 * j + 2)
        want = float(1 - total * Decimal(t) / (v + t2).sqrt())
        assert t_two_sided_values(np.array([t]), np.array([float(v)]))[0] == pytest.approx(want, rel=1e-11)


def test_slopes_out_of_reach_are_not_called_converged():
    x = np.linspace(-2, 2, 2000)
    bins = np.floor(x / de.BIN_WIDTH).astype(int)
    keep = np.unique(bins)
    d = x - (bins + 0.5) * de.BIN_WIDTH
    moments = np.array([[np.sum(d[bins == b] ** i) for i in range(de.ORDER)] for b in keep])
    near = (30 * x[-1] + 2 * x[-2]) / 32
    mean = np.sum(x * np.exp(1.5 * x)) / np.sum(np.exp(1.5 * x))
    slopes, done = de._solve_slopes(np.array([near, mean, -near]), (keep + 0.5) * de.BIN_WIDTH, moments, 200)
    assert done.tolist() == [False, True, False] and slopes[1] == pytest.approx(1.5, abs=1e-8)


def test_model_of_another_database_is_refused(spark):
    ours = spark.createDataFrame([("a|b|L|R|paracrine",)], "lri_name string")
    interactions.require_aligned(ours, ours)
    with pytest.raises(ValueError, match="not found"):
        interactions.require_aligned(ours, spark.createDataFrame([("a|b|L|X|paracrine",)], "lri_name string"))


def test_counts_are_not_exchanged_and_old_factors_go(spark):
    y = np.random.default_rng(5).poisson(0.4, (40, 12))
    counts = counts_table(spark, y)
    rows = counts.select("sample_id", "region_id").distinct()
    cols = counts.select("lri_idx").distinct()
    keys, col = ["sample_id", "region_id"], ["lri_idx"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nnz = cut_lineage(counts.select(*keys, *col, "value").repartition(*keys), keep_layout=True)
        start = factorize.hash_start(keys, 0)
        r, c = factorize._start(rows, keys, 2, start), factorize._start(cols, col, 2, factorize.hash_start(col, 1))
        step = lambda dim, of: factorize._half_step(nnz, r, c, dim, of, keys, col, factorize._sums(c, 2), 1.0, 0.1, 2, 1000)

        def exchanged(df):
            """Exchanges whose input still holds single counts."""
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            at = next(i for i, line in enumerate(plan) if "value#" in line and "RDD" in line)
            above, level = [], depth(plan[at])
            for line in reversed(plan[:at]):
                if depth(line) < level:
                    level = depth(line)
                    above.append(line)
                    if "Aggregate" in line:
                        break
            return [line for line in above if "Exchange" in line and "Broadcast" not in line]

        assert exchanged(step(rows, keys)) == [] and exchanged(step(cols, col)) == []
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        count = lambda: sum(1 for _ in folder.glob("rdd-*"))
        before = count()
        factorize.fit(counts, rows, cols, 2, 3, tol=None)
        few = count() - before
        factorize.fit(counts, rows, cols, 2, 10, tol=None)
        assert count() - before - few == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocked_fit_is_the_same_fit(spark):
    rng = np.random.default_rng(6)
    y = rng.poisson(rng.gamma(0.5, 1, (60, 3)) @ rng.gamma(0.5, 1, (3, 15)))
    y[:, 14] = 0
    y[59] = 0  # a region and a column without counts
    rows = spark.range(60).selectExpr("'S' AS sample_id", "id AS region_id")
    cols = spark.range(15).selectExpr("CAST(id AS INT) AS lri_idx")
    one, two = (f(counts_table(spark, y), rows, cols, 3, 6, tol=-1.0, seed=3) for f in (factorize.fit, factorize.fit_blocked))
    assert np.allclose([h[1] for h in one.history], [h[1] for h in two.history], rtol=1e-9)
    assert [h[0] for h in one.history] == [h[0] for h in two.history] and two.converged is False
    assert (one.row_beta, one.col_beta) == pytest.approx((two.row_beta, two.col_beta))
    for a, b, keys in ((one.rows, two.rows, ["sample_id", "region_id"]), (one.cols, two.cols, ["lri_idx"])):
        a, b = (x.toPandas().set_index(keys).sort_index() for x in (a, b))
        assert set(a.columns) == set(b.columns) and np.allclose(a[sorted(a)], b[sorted(a)], rtol=1e-9)
    whole = factorize.fit_blocked(counts_table(spark, y), rows, cols, 3, seed=3)
    assert whole.converged and whole.history[-1][2] < 1e-4
    # More columns than may be broadcast go the other way.
    wide = factorize.fit_blocked(counts_table(spark, y), rows, cols, 3, 2, None, seed=3, broadcast_rows=5)
    assert np.allclose(wide.cols.toPandas().set_index("lri_idx").sort_index()["g0"], factorize.fit(counts_table(spark, y), rows, cols, 3, 2, None, seed=3).cols.toPandas().set_index("lri_idx").sort_index()["g0"])


def test_blocked_fit_takes_one_job_an_iteration(spark):
    y = np.random.default_rng(4).poisson(2.0, (40, 6))
    rows = spark.createDataFrame([("S0", i) for i in range(40)], "sample_id string, region_id long")
    cols = spark.createDataFrame([(j,) for j in range(6)], "lri_idx int")
    jobs = []
    for steps in (4, 9):
        spark.sparkContext.setJobGroup(f"fit{steps}", "")
        factorize.fit_blocked(counts_table(spark, y), rows, cols, 3, steps, tol=-1.0, seed=3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{steps}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 5


def test_log_gamma_and_priors_of_arrays():
    x = np.array([0.1, 0.5, 1.0, 2.5, 17.0, 400.0])
    assert np.allclose(factorize._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_mixture_on_bins_is_the_mixture_of_all_scores(spark):
    """Against the same steps over every score."""
    rng = np.random.default_rng(9)
    score = np.concatenate([rng.normal(-2, 0.7, 700), rng.normal(1, 0.4, 300), [-23.0]])
    loadings = spark.createDataFrame([("S", i, 0, float(np.exp(v))) for i, v in enumerate(score)], "sample_id string, cell_id long, motif int, loading double")
    for tol, steps in ((None, 7), (1e-3, 100)):
        got = states.fit_mixture(loadings, steps, tol)[0].first()
        s = np.log(np.exp(score) + states.EPS)
        c, last = s - s.mean(), None
        r = (s > (s.min() + s.max()) / 2).astype(float)
        for _ in range(steps + 1):
            w, mu = np.array([(1 - r).mean(), r.mean()]), np.array([np.average(c, weights=1 - r), np.average(c, weights=r)])
            var = np.array([np.average((c - m) ** 2, weights=x) for m, x in zip(mu, (1 - r, r))]) + states.REG_COVAR
            if last is not None and tol is not None and len(last) > 1 and abs(last[-1] - last[-2]) < tol:
                break
            d = [np.log(w[j]) - 0.5 * np.log(2 * np.pi * var[j]) - (c - mu[j]) ** 2 / (2 * var[j]) for j in (0, 1)]
            last = [*(last or []), np.logaddexp(*d).mean()]
            r = 1 / (1 + np.exp(d[0] - d[1]))
        assert (got.w1, got.mu0, got.mu1, got.var0, got.var1) == pytest.approx((w[1], *mu, *var), rel=1e-6)
        assert got.converged == (None if tol is None else True)
    assert states.fit_mixture(loadings.limit(0))[0].count() == 0


def test_projection_of_lists_equals_projection_of_rows(spark):
    cols = spark.createDataFrame([(i, *[float(1 + (i * 3 + k) % 5) for k in (0, 1)], *[float(1 + (i + k) % 3) for k in (0, 1)]) for i in (2, 3, 7)], "lri_idx int, g0 double, g1 double, e0 double, e1 double")
    model = factorize.Model(None, cols, ["sample_id", "region_id"], ["lri_idx"], 2, 0.1, 1.0, 1.0, [])
    rows = spark.createDataFrame([("S", 1, 2, 4), ("S", 1, 7, 1), ("S", 2, 3, 9), ("S", 2, 5, 8), ("S", 2, 9, 8)], "sample_id string, region_id long, lri_idx int, value long")
    cells = spark.createDataFrame([("S", c) for c in (1, 2, 3)], "sample_id string, cell_id long")
    lists = rows.groupBy("sample_id", "region_id").agg(F.collect_list(F.struct("lri_idx", "value")).alias("found"))
    get = lambda m, **kw: {(r.cell_id, r.motif): round(r.loading, 9) for r in factorize.project(m, model, cells, 5, **kw).collect()}
    assert get(lists) == get(rows) == get(lists, broadcast_rows=0)
