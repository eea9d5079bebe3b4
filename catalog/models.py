"""Registered queries: iterative models, run for a fixed number of steps from a fixed start.

The DuckDB side repeats the same steps as a generated chain of CTEs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import FACTOR, K, Inputs, query, r6
from catalog.ranking import two_sided
from catalog.scalars import occupied
from catalog.sources import de_rows
from cellweave.operators import de, factorize, interactions, regions, states, stats

# ---------------------------------------------------------------- mixture model

GMM_STEPS = 5


def _gmm_ctes() -> None:
    c = base.CTE
    c["sc"] = "SELECT sample_id, cell_id, motif, ln(loading + 1e-10) AS s FROM loadings"
    c["sc0"] = """SELECT *, CASE WHEN s > (lo + hi) / 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM (
      SELECT *, min(s) OVER (PARTITION BY motif) AS lo, max(s) OVER (PARTITION BY motif) AS hi, avg(s) OVER (PARTITION BY motif) AS sh FROM sc)"""
    for i in range(GMM_STEPS + 1):
        c[f"gm{i}"] = f"""
  SELECT motif, sh, a0 / (a0 + a1) AS w0, b0 / a0 AS m0, c0 / a0 - (b0 / a0) * (b0 / a0) + 1e-6 AS v0,
         a1 / (a0 + a1) AS w1, b1 / a1 AS m1, c1 / a1 - (b1 / a1) * (b1 / a1) + 1e-6 AS v1
  FROM (SELECT motif, sh, sum(1 - r) + 2.2e-15 AS a0, sum((1 - r) * (s - sh)) AS b0, sum((1 - r) * (s - sh) * (s - sh)) AS c0,
    sum(r) + 2.2e-15 AS a1, sum(r * (s - sh)) AS b1, sum(r * (s - sh) * (s - sh)) AS c1 FROM sc{i} GROUP BY ALL)"""
        dens = lambda j: f"ln(w{j}) - 0.5 * ln(2 * pi() * v{j}) - (s - p.sh - m{j}) * (s - p.sh - m{j}) / (2 * v{j})"
        c[f"sc{i + 1}"] = f"""
  SELECT sample_id, cell_id, motif, s, p.sh, 1 / (1 + exp({dens(0)} - ({dens(1)}))) AS r FROM sc JOIN gm{i} p USING (motif)"""


_gmm_ctes()


@query("mdl_gmm", f"""
SELECT motif, round(m0 + sh, 6) AS mean0, round(m1 + sh, 6) AS mean1, round(w0, 6) AS weight0, round(w1, 6) AS weight1,
  CAST(CASE WHEN m1 >= m0 THEN 1 ELSE 0 END AS INT) AS positive_component FROM gm{GMM_STEPS}""")
def _(t: Inputs):
    summary = states.mixture_summary(*states.fit_mixture(t.loadings(), GMM_STEPS, None))
    return summary.select("motif", *[r6(c, c) for c in ("mean0", "mean1", "weight0", "weight1")], "positive_component")


@query("mdl_gmm_states", f"""
SELECT sample_id, cell_id, motif, round(r, 6) AS posterior, CASE WHEN r > 0.5 THEN 'positive' ELSE 'negative' END AS state FROM sc{GMM_STEPS + 1}""")
def _(t: Inputs):
    loadings = t.loadings()
    s = states.assign_states(loadings, *states.fit_mixture(loadings, GMM_STEPS, None))
    return s.select("sample_id", "cell_id", "motif", r6("posterior", "posterior"), "state")


# The mixture to its stopping rule: SQL makes GMM_WHOLE steps and takes each motif's first at which it holds.
GMM_WHOLE, GMM_TOL = 40, 1e-3


def _gmm_whole_ctes() -> None:
    c = base.CTE
    dens = lambda j: f"ln(w{j}) - 0.5 * ln(2 * pi() * v{j}) - (s - p.sh - m{j}) * (s - p.sh - m{j}) / (2 * v{j})"
    for i in range(1, GMM_WHOLE + 1):
        before = "gm0" if i == 1 else f"gw{i - 1}"
        c[f"gw{i}"] = f"""
  SELECT motif, sh, ll, a0 / (a0 + a1) AS w0, b0 / a0 AS m0, c0 / a0 - (b0 / a0) * (b0 / a0) + 1e-6 AS v0,
         a1 / (a0 + a1) AS w1, b1 / a1 AS m1, c1 / a1 - (b1 / a1) * (b1 / a1) + 1e-6 AS v1
  FROM (SELECT motif, sh, avg(greatest(d0, d1) + ln(exp(d0 - greatest(d0, d1)) + exp(d1 - greatest(d0, d1)))) AS ll,
    sum(1 - r) + 2.2e-15 AS a0, sum((1 - r) * c) AS b0, sum((1 - r) * c * c) AS c0, sum(r) + 2.2e-15 AS a1, sum(r * c) AS b1, sum(r * c * c) AS c1
    FROM (SELECT motif, sh, s - sh AS c, d0, d1, 1 / (1 + exp(d0 - d1)) AS r FROM (
      SELECT motif, p.sh, s, {dens(0)} AS d0, {dens(1)} AS d1 FROM sc JOIN {before} p USING (motif))) GROUP BY ALL)"""
    c["gwall"] = " UNION ALL ".join(f"SELECT {i} AS i, * FROM gw{i}" for i in range(1, GMM_WHOLE + 1))
    c["gwstop"] = f"""
  SELECT motif, min(i) AS n FROM (SELECT motif, i, abs(ll - lag(ll) OVER (PARTITION BY motif ORDER BY i)) AS d FROM gwall) WHERE d < {GMM_TOL} GROUP BY motif"""


_gmm_whole_ctes()


@query("mdl_gmm_converged", """
SELECT motif, round(m0 + sh, 6) AS mean0, round(m1 + sh, 6) AS mean1, round(w0, 6) AS weight0, round(w1, 6) AS weight1,
  round(v0, 6) AS var0, round(v1, 6) AS var1, true AS converged FROM gwall JOIN gwstop USING (motif) WHERE i = n""")
def _(t: Inputs):
    """The mixture as its own rule stops it."""
    params, flat = states.fit_mixture(t.loadings(), tol=GMM_TOL)
    summary = states.mixture_summary(params, flat).join(params.select("motif", "var0", "var1", "converged"), "motif")
    return summary.select("motif", *[r6(c, c) for c in ("mean0", "mean1", "weight0", "weight1", "var0", "var1")], "converged")


# ---------------------------------------------------------------- Poisson regression

GLM_STEPS = 8


def _glm_ctes() -> None:
    c = base.CTE
    c["gs"] = """
  SELECT motif, cell_type, gene, sum(count) AS sy, sum(count * x) AS sxy FROM cov JOIN expression USING (sample_id, cell_id) GROUP BY ALL"""
    c["nb0"] = "SELECT *, CAST(0 AS DOUBLE) AS b FROM gs"
    for i in range(GLM_STEPS):
        c[f"nb{i + 1}"] = f"""
  SELECT motif, cell_type, gene, sy, sxy, b - (s1 / s0 - sxy / sy) / (s2 / s0 - (s1 / s0) * (s1 / s0)) AS b FROM (
    SELECT g.motif, g.cell_type, gene, sy, sxy, b, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1, sum(x * x * exp(b * x)) AS s2
    FROM nb{i} g JOIN cov v ON v.motif = g.motif AND v.cell_type = g.cell_type GROUP BY ALL)"""
    c["glm"] = f"""
  SELECT motif, cell_type, gene, ln(sy / s0) AS intercept, b AS logfc, sqrt(s0 / (sy * s2)) AS se FROM (
    SELECT g.motif, g.cell_type, gene, sy, b, sum(exp(b * x)) AS s0, sum(x * x * exp(b * x)) AS s2
    FROM nb{GLM_STEPS} g JOIN cov v ON v.motif = g.motif AND v.cell_type = g.cell_type GROUP BY ALL)"""
    c["glmp"] = f"SELECT *, {two_sided('logfc / se')} AS pval FROM glm"


_glm_ctes()
FIT = "motif, cell_type, gene, round(intercept, 6) AS intercept, round(logfc, 6) AS logfc, round(se, 6) AS se, round(pval, 6) AS pval"


def _fit(t: Inputs, **kw):
    f = de.poisson_glm(stats.covariates(t.loadings(), t.cells()), t.expression(), **kw)
    return f.select("motif", "cell_type", "gene", *[r6(c, c) for c in ("intercept", "logfc", "se", "pval")])


@query("mdl_glm", f"SELECT {FIT} FROM glmp")
def _(t: Inputs):
    return _fit(t)


@query("mdl_glm_batched", f"SELECT {FIT} FROM glmp")
def _(t: Inputs):
    # Small tiles: several batches of genes per (motif, cell type).
    return _fit(t, tile=7)


base.CTE["derun"] = """
  SELECT motif, cell_type, gene, logfc, pval, least(1, min(pval * m / rk) OVER (PARTITION BY motif, cell_type ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS qval
  FROM (SELECT *, row_number() OVER (PARTITION BY motif, cell_type ORDER BY pval) AS rk, count(*) OVER (PARTITION BY motif, cell_type) AS m FROM glmp
    WHERE gene NOT IN (SELECT trim(unnest(string_split(f, '_'))) FROM (SELECT unnest([ligand, receptor]) AS f FROM lri))
      AND (motif, cell_type, gene) IN (SELECT (motif, cell_type, gene) FROM prefiltered))"""
base.CTE["prefiltered"] = f"SELECT motif, cell_type, gene FROM spearz WHERE {two_sided('zz')} < 0.5"


@query("mdl_de_run", "SELECT motif, cell_type, gene, round(logfc, 6) AS logfc, round(pval, 6) AS pval, round(qval, 6) AS qval, qval <= 0.9 AS significant FROM derun")
def _(t: Inputs):
    out = de.run_de(t.loadings(), t.cells(), t.expression(), t.genes(), t.lri(), alpha=0.9, spearman_threshold=0.5)
    return out.select("motif", "cell_type", "gene", r6("logfc", "logfc"), r6("pval", "pval"), r6("qval", "qval"), "significant")


@query("mdl_de_report", """
, kept AS (SELECT d.* FROM de d JOIN dn USING (cell_type, gene)
  JOIN (SELECT cell_type, count(*) AS nc FROM cells WHERE cell_type IS NOT NULL GROUP BY ALL) USING (cell_type)
  WHERE qval IS NOT NULL AND n / nc >= 0.1 AND NOT EXISTS (
    SELECT 1 FROM mwq m WHERE m.gene = d.gene AND m.cell_type <> d.cell_type AND m.padj <= 0.9 AND m.log2fc >= 0.01))
SELECT motif, cell_type, gene, round(score, 6) AS score FROM (SELECT *, abs(logfc) * -log10(greatest(qval, 1e-300)) AS score FROM kept WHERE abs(logfc) <= 10)
QUALIFY row_number() OVER (PARTITION BY motif, cell_type ORDER BY score DESC, gene) <= 5""")
def _(t: Inputs):
    out = de.report(de_rows(t), t.cells(), t.expression(), min_fraction=0.1, marker_lfc=0.01, marker_p=0.9, subsample=None, n_forest=5)
    return out["forest"].select("motif", "cell_type", "gene", r6("score", "score"))


# ---------------------------------------------------------------- factorization

FIT_K, FIT_STEPS, ALPHA = 3, 2, 0.1
ROW_START = "0.5 + CAST((region_id * 37 + {k} * 101 + 17) % 1009 AS DOUBLE) / 1009"
COL_START = "0.5 + CAST((lri_idx * 53 + {k} * 211 + 29) % 997 AS DOUBLE) / 997"


def sql_digamma(x: str) -> str:
    z, series = f"({x} + 6)", [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760, -1 / 12]
    terms = " + ".join(f"({c!r}::DOUBLE) / pow({z}, {2 * i + 2})" for i, c in enumerate(series))
    return f"(ln({z}) - 0.5 / {z} + {terms} - " + " - ".join(f"1 / ({x} + {i})" for i in range(6)) + ")"


def _fit_ctes() -> None:
    c, ks = base.CTE, range(FIT_K)
    c["ymat"] = "SELECT sample_id, region_id, lri_idx, CAST(value AS DOUBLE) AS value FROM pmatrix JOIN lri USING (lr_id, celltype1, celltype2, mode)"
    c["rdim"] = "SELECT DISTINCT sample_id, region_id FROM pmember"
    both = lambda s: ", ".join(f"{s.format(k=k)} AS g{k}, {s.format(k=k)} AS e{k}" for k in ks)
    c["rowf0"] = f"SELECT sample_id, region_id, {both(ROW_START)} FROM rdim"
    c["colf0"] = f"SELECT lri_idx, {both(COL_START)} FROM lri"

    def sums(f: str) -> str:
        return f"SELECT {', '.join(f'sum(e{k}) AS t{k}' for k in ks)}, count(*) * {FIT_K} / sum({' + '.join(f'e{k}' for k in ks)}) AS beta FROM {f}"

    def step(keys: str, dim: str, row: str, col: str, other: str, own: str) -> str:
        total = " + ".join(f"r.g{k} * c.g{k}" for k in ks)
        shares = ", ".join(f"sum(value * r.g{k} * c.g{k} / ({total})) AS s{k}" for k in ks)
        shape = lambda k: f"({ALPHA} + coalesce(s{k}, 0))"
        rate = lambda k: f"({ALPHA} * o.beta + x.t{k})"
        outs = ", ".join(f"{shape(k)} AS shape{k}, exp({sql_digamma(shape(k))}) / {rate(k)} AS g{k}, {shape(k)} / {rate(k)} AS e{k}" for k in ks)
        return f"""
  SELECT {keys}, {outs} FROM {dim} LEFT JOIN (SELECT {keys}, {shares} FROM ymat
    JOIN {row} r USING (sample_id, region_id) JOIN {col} c USING (lri_idx) GROUP BY {keys}) USING ({keys}), {own} o, {other} x"""

    c["rsum0"], c["csum0"] = sums("rowf0"), sums("colf0")
    for i in range(FIT_STEPS):
        c[f"rowf{i + 1}"] = step("sample_id, region_id", "rdim", f"rowf{i}", f"colf{i}", f"csum{i}", f"rsum{i}")
        c[f"rsum{i + 1}"] = sums(f"rowf{i + 1}")
        c[f"colf{i + 1}"] = step("lri_idx", "lri", f"rowf{i + 1}", f"colf{i}", f"rsum{i + 1}", f"csum{i}")
        c[f"csum{i + 1}"] = sums(f"colf{i + 1}")


_fit_ctes()


def fit_inputs(t: Inputs):
    matrix, columns = t.matrix(), t.lri()
    rows = regions.assign_patches(t.cells()).where("patch_id IS NOT NULL").select(
        "sample_id", F.col("patch_id").alias("region_id")
    ).distinct()
    return interactions.indexed_matrix(matrix, columns), rows, columns


def fixed_fit(t: Inputs):
    matrix, rows, columns = fit_inputs(t)
    return factorize.fit(
        matrix, rows, columns, FIT_K, FIT_STEPS, None, ALPHA,
        row_start=lambda k: F.expr(ROW_START.format(k=k)), col_start=lambda k: F.expr(COL_START.format(k=k)),
    )


def _unpivot(table: str, keys: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, CAST({k} AS INT) AS motif, round(g{k}, 6) AS {name} FROM {table}" for k in range(FIT_K))


@query("mdl_bpf_fit", _unpivot(f"rowf{FIT_STEPS}", "sample_id, region_id", "loading"))
def _(t: Inputs):
    return fixed_fit(t).row_loadings().withColumn("loading", F.round("loading", 6))


@query("mdl_bpf_factors", _unpivot(f"colf{FIT_STEPS}", "lri_idx", "factor"))
def _(t: Inputs):
    return fixed_fit(t).column_factors().withColumn("factor", F.round("factor", 6))


# The production fit: K = 15, stopped by the bound's relative gain. SQL makes WHOLE_STEPS iterations and
# takes the first at which the rule holds.
WHOLE_K, WHOLE_TOL, WHOLE_STEPS = 15, 1e-4, 48


def _whole_fit_ctes() -> None:
    c, ks = base.CTE, range(WHOLE_K)
    tables = {"r": ("sample_id, region_id", "rdim", ROW_START), "c": ("lri_idx", "lri", COL_START)}

    def named(x: str, i: int) -> None:
        """Wide factors, column sums and rate of the long factors wl."""
        keys = tables[x][0]
        c[f"wf{x}{i}"] = f"SELECT {keys}, {', '.join(f'max(g) FILTER (k = {k}) AS g{k}' for k in ks)} FROM wl{x}{i} GROUP BY {keys}"
        c[f"wt{x}{i}"] = f"SELECT k, sum(e) AS t FROM wl{x}{i} GROUP BY k"
        c[f"wb{x}{i}"] = f"SELECT count(*) / sum(e) AS beta FROM wl{x}{i}"

    def half(x: str, i: int, row: str, col: str, other: str) -> None:
        keys, dim, _ = tables[x]
        total = " + ".join(f"r.g{k} * c.g{k}" for k in ks)
        c[f"ws{x}{i}"] = f"""
  SELECT {keys}, {', '.join(f'sum(value * p{k} / total) AS s{k}' for k in ks)} FROM (SELECT sample_id, region_id, lri_idx, value,
    {', '.join(f'r.g{k} * c.g{k} AS p{k}' for k in ks)}, {total} AS total FROM ymat JOIN {row} r USING (sample_id, region_id) JOIN {col} c USING (lri_idx)) GROUP BY {keys}"""
        c[f"wl{x}{i}"] = f"""
  SELECT {keys}, k, shape, rate, exp({sql_digamma('shape')}) / rate AS g, shape / rate AS e FROM (
    SELECT {keys}, k, {ALPHA} + coalesce(s, 0) AS shape, {ALPHA} * beta + t AS rate FROM (SELECT {keys}, unnest(range({WHOLE_K})) AS k FROM {dim})
    LEFT JOIN (SELECT {keys}, unnest(range({WHOLE_K})) AS k, unnest([{', '.join(f's{k}' for k in ks)}]) AS s FROM ws{x}{i}) USING ({keys}, k)
    JOIN {other} USING (k), wb{x}{i - 1})"""
        named(x, i)

    def prior(x: str, i: int) -> str:
        return f"""(SELECT sum({ALPHA} * ln({ALPHA} * beta) - lgamma({ALPHA}) + ({ALPHA} - 1) * ln(g) - {ALPHA} * beta * e + shape - ln(rate)
    + lgamma(shape) + (1 - shape) * (ln(g) + ln(rate))) FROM wl{x}{i}, wb{x}{i - 1})"""

    for x, (keys, dim, start) in tables.items():
        formula = start.replace("{k}", "k")
        c[f"wl{x}0"] = f"SELECT {keys}, k, {formula} AS g, {formula} AS e FROM (SELECT {keys}, unnest(range({WHOLE_K})) AS k FROM {dim})"
        named(x, 0)
    total = " + ".join(f"r.g{k} * c.g{k}" for k in ks)
    for i in range(1, WHOLE_STEPS + 1):
        half("r", i, f"wfr{i - 1}", f"wfc{i - 1}", f"wtc{i - 1}")
        half("c", i, f"wfr{i}", f"wfc{i - 1}", f"wtr{i}")
        c[f"wbound{i}"] = f"""
  SELECT {i} AS i, (SELECT sum(value * ln({total}) - lgamma(value + 1)) FROM ymat JOIN wfr{i} r USING (sample_id, region_id) JOIN wfc{i} c USING (lri_idx))
    - (SELECT sum(r.t * c.t) FROM wtr{i} r JOIN wtc{i} c USING (k)) + {prior("r", i)} + {prior("c", i)} AS b"""
    c["wstop"] = f"""
  SELECT min(i) AS n, min_by(b, i) AS b FROM (SELECT i, b, (b - lag(b) OVER (ORDER BY i)) / abs(lag(b) OVER (ORDER BY i)) AS d FROM (
    {" UNION ALL ".join(f"FROM wbound{i}" for i in range(1, WHOLE_STEPS + 1))})) WHERE d < {WHOLE_TOL}"""


_whole_fit_ctes()


@query("mdl_bpf_converged", " UNION ALL ".join(
    f"SELECT lri_idx, CAST(k AS INT) AS motif, round(g, 4) AS factor, CAST(n AS INT) AS n_iterations, round(b, 2) AS bound, true AS converged FROM wlc{i}, wstop WHERE n = {i}"
    for i in range(2, WHOLE_STEPS + 1)))
def _(t: Inputs):
    """Column factors of the fit that its own rule stopped, with the number of iterations and the bound."""
    matrix, rows, columns = fit_inputs(t)
    model = factorize.fit_blocked(
        matrix, rows, columns, WHOLE_K, 300, WHOLE_TOL, ALPHA,
        row_start=lambda k: F.expr(ROW_START.format(k=k)), col_start=lambda k: F.expr(COL_START.format(k=k)),
    )
    n, bound, _ = model.history[-1]
    return model.column_factors().select(
        "lri_idx", "motif", F.round("factor", 4).alias("factor"), F.lit(n).alias("n_iterations"), F.lit(round(bound, 2)).alias("bound"),
        F.lit(model.converged).alias("converged"),
    )


@query("mdl_bpf_row_totals", "SELECT sample_id, region_id, CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM rdim LEFT JOIN ymat USING (sample_id, region_id) GROUP BY ALL")
def _(t: Inputs):
    """After a row update the shape gains of a row add up to its counts."""
    m = fixed_fit(t)
    gain = sum((F.col(f"shape{k}") - ALPHA for k in range(FIT_K)), F.lit(0.0))
    return m.rows.select("sample_id", "region_id", F.round(gain).cast("long").alias("total"))


@query("mdl_bpf_bound", "SELECT true AS never_decreases, 8 AS n_steps FROM (SELECT count(*) FROM ymat)")
def _(t: Inputs):
    matrix, rows, columns = fit_inputs(t)
    model = factorize.fit(matrix, rows, columns, 4, 9, tol=-1.0, seed=42)
    h = factorize.history_table(model, t.spark)
    return h.agg(F.every(F.coalesce("delta", F.lit(0.0)) >= -1e-12).alias("never_decreases"), F.count("*").cast("int").alias("n_steps"))


PROJECT_STEPS = 3


def _project_ctes() -> None:
    c, ks = base.CTE, range(K)
    c["pcol"] = "SELECT lri_idx, " + ", ".join(f"max(factor) FILTER (motif = {k}) AS g{k}" for k in ks) + " FROM factors GROUP BY lri_idx"
    c["psum"] = "SELECT " + ", ".join(f"sum(g{k}) AS t{k}" for k in ks) + " FROM pcol"
    c["ynear"] = "SELECT n.sample_id, n.region_id, lri.lri_idx, CAST(value AS DOUBLE) AS value FROM nmatrix n JOIN lri USING (lr_id, celltype1, celltype2, mode)"
    c["proj0"] = "SELECT sample_id, cell_id AS region_id, " + ", ".join(f"CAST(1 AS DOUBLE) AS g{k}" for k in ks) + " FROM cells"
    for i in range(PROJECT_STEPS):
        total = " + ".join(f"r.g{k} * c.g{k}" for k in ks)
        shares = ", ".join(f"sum(value * r.g{k} * c.g{k} / ({total})) AS s{k}" for k in ks)
        outs = ", ".join(f"exp({sql_digamma(f'(0.1 + coalesce(s{k}, 0))')}) / (0.1 + t{k}) AS g{k}" for k in ks)
        c[f"proj{i + 1}"] = f"""
  SELECT sample_id, region_id, {outs} FROM (SELECT sample_id, cell_id AS region_id FROM cells) LEFT JOIN (
    SELECT sample_id, region_id, {shares} FROM ynear JOIN proj{i} r USING (sample_id, region_id) JOIN pcol c USING (lri_idx)
    GROUP BY sample_id, region_id) USING (sample_id, region_id), psum"""


_project_ctes()


def fixture_model(t: Inputs, columns):
    """Column factors from the stand-in table, as a model with unit row rate."""
    g = [F.expr(FACTOR.replace("k * 17", f"{k} * 17")) for k in range(K)]
    cols = columns.select("lri_idx", *[c.alias(f"g{k}") for k, c in enumerate(g)], *[c.alias(f"e{k}") for k, c in enumerate(g)])
    return factorize.Model(None, cols, ["sample_id", "region_id"], ["lri_idx"], K, ALPHA, 1.0, 1.0, [])


@query("mdl_project", " UNION ALL ".join(
    f"SELECT sample_id, region_id AS cell_id, CAST({k} AS INT) AS motif, round(g{k}, 6) AS loading FROM proj{PROJECT_STEPS}" for k in range(K)))
def _(t: Inputs):
    pairs, columns = t.pairs(), t.lri()
    aligned = interactions.cell_lists(t.cells(), t.expression(), pairs, columns)
    out = factorize.project(aligned, fixture_model(t, columns), t.cells(), max_iter=PROJECT_STEPS)
    return out.withColumn("loading", F.round("loading", 6))


base.CTE["thinp"] = """
  SELECT lri_idx, mean, least(1, quantile_cont(mean, 0.6) OVER () / mean) AS p FROM (
    SELECT lri_idx, sum(value) / (SELECT count(*) FROM patchtable) AS mean FROM ymat GROUP BY ALL)"""


def _indexed(t: Inputs):
    return interactions.indexed_matrix(t.matrix(), t.lri())


@query("mdl_thin", "SELECT lri_idx, round(mean, 6) AS mean, round(p, 6) AS p FROM thinp")
def _(t: Inputs):
    return factorize.thin_probabilities(_indexed(t), occupied(t), 0.6).select("lri_idx", r6("mean", "mean"), r6("p", "p"))


@query("mdl_thin_draw", "SELECT lri_idx, true AS bounded, CAST(CASE WHEN p >= 1 THEN total END AS BIGINT) AS kept_whole FROM thinp JOIN (SELECT lri_idx, sum(value) AS total FROM ymat GROUP BY ALL) USING (lri_idx)")
def _(t: Inputs):
    """Draws never exceed the counts; columns at or below the quantile are kept whole."""
    m = _indexed(t)
    probs = factorize.thin_probabilities(m, occupied(t), 0.6)
    drawn = factorize.thin(m, probs, ["sample_id", "region_id"], seed=7).withColumnRenamed("value", "kept")
    both = m.join(drawn, ["sample_id", "region_id", "lri_idx"], "left").join(probs, "lri_idx")
    return both.groupBy("lri_idx", "p").agg(
        F.every(F.coalesce("kept", F.lit(0)) <= F.col("value")).alias("bounded"), F.sum("kept").alias("k")
    ).select("lri_idx", "bounded", F.when(F.col("p") >= 1, F.col("k")).alias("kept_whole"))


@query("smp_cells", "SELECT cell_type, least(count(*), 100) AS n, true AS all_distinct FROM cells WHERE cell_type IS NOT NULL GROUP BY ALL")
def _(t: Inputs):
    from cellweave.operators.ranks import sample_group

    typed = t.cells().where("cell_type IS NOT NULL")
    drawn = sample_group(typed, ["cell_type"], 100, ["sample_id", "cell_id"], seed=3)
    return drawn.groupBy("cell_type").agg(F.count("*").alias("n"), (F.countDistinct("cell_id") == F.count("*")).alias("all_distinct"))
