"""Registered queries: windows, rankings and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import Inputs, query, r6
from catalog.scalars import motif_table
from catalog.sources import de_rows
from cellweave.operators import de, motifs, ranks, regions, stats


def two_sided(z: str) -> str:
    """SQL for P(|Z| >= |z|) by the all-positive erf series."""
    x = f"least(greatest(abs({z}) / sqrt(2), 1e-9), 7.5)"
    return f"(1 - list_sum([exp(-({x}) * ({x}) + (2 * i + 1) * ln({x}) - lgamma(i + 1.5)) for i in range(0, 220)]))"


@query("win_patch_idx", """
SELECT p.sample_id, p.cell_id, coalesce(t.patch_idx, -1) AS patch_idx, coalesce(t.global_patch_idx, -1) AS global_patch_idx
FROM patches p LEFT JOIN patchtable t ON p.sample_id = t.sample_id AND p.patch_id = t.patch_id""")
def _(t: Inputs):
    return regions.patch_index(regions.assign_patches(t.cells()))


base.CTE["bestlri"] = """
  SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY motif, signaling_type, receptor, celltype1, celltype2 ORDER BY factor DESC, lri_idx) = 1"""


@query("win_top_lri", """
SELECT motif, lri_idx, round(factor, 6) AS factor, CAST(row_number() OVER (PARTITION BY motif ORDER BY factor DESC, lri_idx) AS INT) AS rank FROM bestlri QUALIFY rank <= 20""")
def _(t: Inputs):
    return motifs.top_interactions(motif_table(t), 20).select("motif", "lri_idx", r6("factor", "factor"), "rank")


@query("win_top_pairs", """
SELECT motif, celltype1, celltype2, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY motif ORDER BY weight DESC, celltype1, celltype2) AS INT) AS rank
FROM (SELECT motif, celltype1, celltype2, sum(factor) AS weight FROM lm GROUP BY ALL) QUALIFY rank <= 10""")
def _(t: Inputs):
    return motifs.top_pairs(motif_table(t), 10).withColumn("weight", F.round("weight", 6))


@query("win_edge_gate", "SELECT motif, celltype1, celltype2 FROM netedges WHERE weight > 2.5")
def _(t: Inputs):
    return motifs.edge_gate(motif_table(t), 40, threshold=2.5)


@query("win_edge_threshold", "SELECT motif, celltype1, celltype2, round(weight, 6) AS weight FROM netedges WHERE weight > 1.5")
def _(t: Inputs):
    return motifs.edges_above(motifs.network_edges(motif_table(t), 40), 1.5).withColumn("weight", F.round("weight", 6))


base.CTE["outl"] = """
  SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (weight - med) / mad WHEN sd > 0 THEN (weight - av) / sd ELSE 0 END AS score FROM (
    SELECT *, median(abs(weight - med)) OVER (PARTITION BY motif) AS mad FROM (
      SELECT *, median(weight) OVER (PARTITION BY motif) AS med, stddev_pop(weight) OVER (PARTITION BY motif) AS sd,
        avg(weight) OVER (PARTITION BY motif) AS av FROM netedges))"""
base.CTE["outr"] = """
  SELECT *, row_number() OVER (PARTITION BY motif ORDER BY weight DESC, celltype1, celltype2) AS rn FROM outl WHERE score > 0.8"""


@query("win_edge_outlier")
def _(t: Inputs):
    kept = motifs.outlier_edges(motifs.network_edges(motif_table(t), 40), 4, 0.8)
    return kept.withColumn("weight", F.round("weight", 6)).withColumn("score", F.round("score", 6))


# The greedy choice as a recursion over the ranked edges of each motif.
base.SQL["win_edge_outlier"] = base.sql("FROM outr").removesuffix("FROM outr").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
steps(motif, rn, nodes, taken) AS (
  SELECT motif, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM (SELECT DISTINCT motif FROM outr)
  UNION ALL
  SELECT o.motif, o.rn,
    CASE WHEN len(list_distinct(s.nodes || [o.celltype1, o.celltype2])) <= 4 THEN list_distinct(s.nodes || [o.celltype1, o.celltype2]) ELSE s.nodes END,
    len(list_distinct(s.nodes || [o.celltype1, o.celltype2])) <= 4
  FROM steps s JOIN outr o ON o.motif = s.motif AND o.rn = s.rn + 1)
SELECT o.motif, o.celltype1, o.celltype2, round(weight, 6) AS weight, round(score, 6) AS score
FROM outr o JOIN steps s ON s.motif = o.motif AND s.rn = o.rn AND s.taken"""


@query("win_edge_labels", """
, byrec AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY motif, receptor ORDER BY factor DESC, lri_idx) = 1),
top20 AS (SELECT * FROM byrec QUALIFY row_number() OVER (PARTITION BY motif ORDER BY factor DESC, lri_idx) <= 20),
listed AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY motif ORDER BY factor DESC, lri_idx) <= 40),
marked AS (SELECT l.*, EXISTS (SELECT 1 FROM top20 b WHERE b.motif = l.motif AND b.celltype1 = l.celltype1 AND b.celltype2 = l.celltype2
  AND b.ligand = l.ligand AND b.receptor = l.receptor) AS in_top FROM listed l),
usable2 AS (SELECT * FROM (SELECT *, bool_or(in_top) OVER (PARTITION BY motif, celltype1, celltype2) AS any_top FROM marked) WHERE in_top OR NOT any_top)
SELECT motif, celltype1, celltype2, string_agg(ligand || '-' || receptor, chr(10) ORDER BY rn) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY motif, celltype1, celltype2 ORDER BY factor DESC, lri_idx) AS rn FROM usable2) WHERE rn <= 3 GROUP BY ALL""")
def _(t: Inputs):
    df = motif_table(t)
    return motifs.edge_labels(df, motifs.network_edges(df, 40), 40)


base.CTE["covrank"] = """
  SELECT *, rank() OVER (PARTITION BY motif, cell_type ORDER BY loading) + (count(*) OVER (PARTITION BY motif, cell_type, loading) - 1) / 2 AS rx FROM cov"""


@query("stat_rank_avg", "SELECT sample_id, cell_id, motif, rx AS rank FROM covrank")
def _(t: Inputs):
    cov = stats.covariates(t.loadings(), t.cells())
    return ranks.rank_rows(cov, ["motif", "cell_type"], "loading").select("sample_id", "cell_id", "motif", "rank")


# Dense typed cells x genes, zeros included: the plain definition.
base.CTE["dense"] = """
  SELECT c.sample_id, c.cell_id, c.cell_type, g.gene, coalesce(e.count, 0) AS count FROM cells c CROSS JOIN panel g
  LEFT JOIN expression e ON e.cell_id = c.cell_id AND e.gene = g.gene WHERE c.cell_type IS NOT NULL"""
base.CTE["spear"] = """
  SELECT motif, cell_type, gene, count(*) AS n, CASE WHEN stddev_pop(ry) = 0 THEN 0 ELSE corr(rx, ry) END AS rho, max(count) AS top
  FROM covrank JOIN (SELECT sample_id, cell_id, gene, count, rank() OVER (PARTITION BY cell_type, gene ORDER BY count)
    + (count(*) OVER (PARTITION BY cell_type, gene, count) - 1) / 2 AS ry FROM dense) USING (sample_id, cell_id) GROUP BY ALL"""
base.CTE["speart"] = "SELECT *, n - 2.5 AS a, abs(rho) * sqrt((n - 2) / (1 - rho * rho + 1e-10)) AS t FROM spear WHERE top > 0"
base.CTE["spearz"] = """SELECT *, z + (z * z * z + 3 * z) / (48 * a * a) - (4 * z ** 7 + 33 * z ** 5 + 240 * z ** 3 + 855 * z)
  / (480 * a * a * (48 * a * a + 0.8 * z ** 4 + 100)) AS zz FROM (SELECT *, sqrt(a * ln(1 + t * t / (n - 2))) AS z FROM speart)"""


def _spearman(t: Inputs):
    return stats.spearman(stats.covariates(t.loadings(), t.cells()), t.expression())


@query("stat_spearman", "SELECT motif, cell_type, gene, n, round(rho, 6) AS rho FROM spear WHERE top > 0")
def _(t: Inputs):
    return _spearman(t).select("motif", "cell_type", "gene", "n", r6("rho", "rho"))


@query("stat_spearman_p", f"SELECT motif, cell_type, gene, round({two_sided('zz')}, 6) AS pval FROM spearz")
def _(t: Inputs):
    return _spearman(t).select("motif", "cell_type", "gene", r6("pval", "pval"))


@query("stat_prefilter", f"SELECT motif, cell_type, gene FROM spearz WHERE {two_sided('zz')} < 0.1")
def _(t: Inputs):
    return stats.spearman_prefilter(_spearman(t), 0.1)


base.CTE["mwr"] = """
  SELECT *, rank() OVER (PARTITION BY gene ORDER BY count) + (count(*) OVER (PARTITION BY gene, count) - 1) / 2 AS r,
    count(*) OVER (PARTITION BY gene, count) AS tie FROM dense"""
base.CTE["mwg"] = "SELECT gene, count(*) AS n, sum(CAST(tie AS DOUBLE) * tie - 1) AS ties, sum(count) AS total, count(*) FILTER (count > 0) AS nz FROM mwr GROUP BY ALL"
base.CTE["mwi"] = """
  SELECT cell_type, gene, count(*) AS n1, sum(r) AS r1, sum(count) AS total_in, count(*) FILTER (count > 0) AS nz_in FROM mwr GROUP BY ALL"""
base.CTE["mwz"] = """
  SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z,
    log2(greatest(total_in / n1, 1e-300)) - log2(greatest((total - total_in) / n2, 1e-300)) AS log2fc,
    (nz - nz_in) / n2 >= 1e-4 AND mean_frac >= 1e-4 AS tested
  FROM (SELECT *, CAST(n - n1 AS DOUBLE) AS n2, r1 - n1 * (n1 + 1) / 2 AS u1, sum(nz_in) OVER (PARTITION BY cell_type) / (n1 * count(*) OVER (PARTITION BY cell_type)) AS mean_frac
    FROM mwi JOIN mwg USING (gene))"""
base.CTE["mwp"] = f"SELECT *, CASE WHEN NOT tested THEN 1 WHEN z <= 0 THEN 1 ELSE {two_sided('z')} END AS pval FROM mwz"
base.CTE["mwq"] = """
  SELECT *, least(1, min(pval * m / rk) OVER (PARTITION BY cell_type ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY pval) AS rk, count(*) OVER (PARTITION BY cell_type) AS m FROM mwp WHERE tested)"""


@query("stat_mwu", "SELECT cell_type, gene, CASE WHEN tested THEN u1 END AS u1, round(pval, 6) AS pval FROM mwp")
def _(t: Inputs):
    d = stats.differential_expression(t.cells(), t.expression())
    return d.select("cell_type", "gene", "u1", r6("pval", "pval"))


@query("stat_de", "SELECT cell_type, gene, round(log2fc, 6) AS log2fc, round(pval, 6) AS pval, round(padj, 6) AS padj FROM mwq")
def _(t: Inputs):
    d = stats.differential_expression(t.cells(), t.expression()).where("tested")
    return d.select("cell_type", "gene", r6("log2fc", "log2fc"), r6("pval", "pval"), r6("padj", "padj"))


@query("stat_de_panel", """
SELECT cell_type, gene, round(log2fc, 6) AS log2fc, round(pval, 6) AS pval, round(padj, 6) AS padj, true AS tested FROM mwq
UNION ALL SELECT cell_type, gene, 0, 1, 1, false FROM (SELECT DISTINCT cell_type FROM cells WHERE cell_type IS NOT NULL), (VALUES ('unseen1'), ('unseen2')) u(gene)""")
def _(t: Inputs):
    more = t.panel().limit(1).select(F.explode(F.array(F.lit("unseen1"), F.lit("unseen2"))).alias("gene"))
    d = stats.differential_expression(t.cells(), t.expression(), genes=t.panel().union(more))
    return d.select("cell_type", "gene", r6("log2fc", "log2fc"), r6("pval", "pval"), r6("padj", "padj"), "tested")


@query("stat_markers", "SELECT cell_type, gene FROM mwq WHERE padj <= 0.9 AND log2fc >= 0.01")
def _(t: Inputs):
    d = stats.differential_expression(t.cells(), t.expression())
    return stats.marker_genes(d, lfc=0.01, p=0.9)


@query("stat_bh", """
SELECT motif, cell_type, gene, round(least(1, min(pval * m / rk) OVER (PARTITION BY motif, cell_type ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q
FROM (SELECT *, row_number() OVER (PARTITION BY motif, cell_type ORDER BY pval) AS rk, count(*) OVER (PARTITION BY motif, cell_type) AS m FROM de)""")
def _(t: Inputs):
    d = stats.benjamini_hochberg(de_rows(t).drop("qval"), ["motif", "cell_type"], "pval", "q")
    return d.select("motif", "cell_type", "gene", r6("q", "q"))


@query("win_volcano", """
, a AS (SELECT *, -log10(greatest(qval, 1e-300)) AS y FROM de WHERE qval IS NOT NULL),
b AS (SELECT *, max(abs(logfc)) OVER w AS mx, max(y) OVER w AS my FROM a WINDOW w AS (PARTITION BY motif, cell_type)),
c AS (SELECT *, CASE WHEN mx > 0 AND my > 0 THEN abs(logfc) / mx + y / my ELSE 0 END AS score,
  CASE WHEN logfc >= 0.2 AND y >= -log10(0.05) THEN 'up' WHEN logfc <= -0.2 AND y >= -log10(0.05) THEN 'down'
       WHEN logfc >= 0.2 THEN 'right_ns' WHEN logfc <= -0.2 THEN 'left_ns' ELSE 'middle' END AS class FROM b)
SELECT motif, cell_type, gene, class, round(score, 6) AS score,
  class IN ('up', 'down') AND row_number() OVER (PARTITION BY motif, cell_type, class ORDER BY score DESC, gene) <= 3 AS labeled FROM c""")
def _(t: Inputs):
    v = de.volcano(de_rows(t), n_top=3)
    return v.select("motif", "cell_type", "gene", "class", r6("score", "score"), "labeled")


base.CTE["forestall"] = """
  SELECT * FROM (SELECT *, abs(logfc) * -log10(greatest(qval, 1e-300)) AS score FROM de WHERE qval IS NOT NULL AND abs(logfc) <= 10)
  QUALIFY row_number() OVER (PARTITION BY motif, cell_type ORDER BY score DESC, gene) <= 8"""


@query("win_forest", """
SELECT motif, cell_type, gene, round(score, 6) AS score, round(logfc - 1.96 * se, 6) AS ci_low, round(logfc + 1.96 * se, 6) AS ci_high,
  CAST(row_number() OVER (PARTITION BY motif, cell_type ORDER BY logfc, gene) AS INT) AS position FROM forestall""")
def _(t: Inputs):
    f = de.forest(de_rows(t), 8)
    return f.select("motif", "cell_type", "gene", r6("score", "score"), r6("ci_low", "ci_low"), r6("ci_high", "ci_high"), "position")
