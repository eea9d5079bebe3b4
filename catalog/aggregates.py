"""Registered queries: aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import K, Inputs, query, r6
from catalog.ranking import two_sided
from catalog.scalars import motif_table, occupied
from catalog.sources import CELL_TYPES, marker_rows
from cellweave.operators import factorize, interactions, lrdb, motifs, regions, states, stats
from cellweave.sources import readers


@query("agg_gene_region", "SELECT sample_id, region_id, cell_type, gene, n FROM pgc")
def _(t: Inputs):
    pairs = t.pairs()
    return interactions.region_gene_counts(interactions.patch_counts(t.cells(), t.expression(), pairs), pairs)


@query("agg_complex_min", "SELECT sample_id, region_id, lr_id, side, cell_type, n FROM pcx")
def _(t: Inputs):
    pairs = t.pairs()
    counts = interactions.patch_counts(t.cells(), t.expression(), pairs)
    return interactions.complex_counts(counts, pairs, ["sample_id", "region_id"]).where("side <> 'A'")


@query("agg_autocrine", "SELECT sample_id, region_id, lr_id, cell_type, n FROM pauto")
def _(t: Inputs):
    pairs = t.pairs()
    counts = interactions.patch_counts(t.cells(), t.expression(), pairs)
    return interactions.complex_counts(counts, pairs, ["sample_id", "region_id"]).where("side = 'A'").drop("side")


@query("agg_patch_lri", "SELECT * FROM pmatrix")
def _(t: Inputs):
    return interactions.patch_lri(t.cells(), t.expression(), t.pairs())


@query("agg_cell_lri", "SELECT * FROM nmatrix")
def _(t: Inputs):
    return interactions.cell_lri(t.cells(), t.expression(), t.pairs())


@query("agg_append_genes", """
SELECT sample_id, region_id, concat_ws('|', celltype1, celltype2, ligand, receptor, mode) AS lri_name, value FROM pmatrix JOIN lrusable USING (lr_id)
UNION ALL SELECT sample_id, region_id, 'GENE|' || gene, CAST(sum(count) AS BIGINT) FROM pmember JOIN expression USING (sample_id, cell_id)
WHERE gene IN (SELECT gene FROM genes GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM genes)) GROUP BY ALL""")
def _(t: Inputs):
    cells, pairs = t.cells(), t.pairs()
    member = regions.assign_patches(cells).where("patch_id IS NOT NULL").select("sample_id", "cell_id", F.col("patch_id").alias("region_id"))
    named = interactions.named_matrix(t.matrix(), pairs)
    return interactions.append_gene_features(named, member, t.expression(), interactions.shared_genes(t.genes()))


@query("agg_drop_zero_cols", "SELECT lri_idx, lri_name FROM lri")
def _(t: Inputs):
    return t.lri().select("lri_idx", "lri_name")


@query("agg_matrix_stats", """
SELECT r AS n_regions, c AS n_columns, z AS nnz, g AS n_shared_genes, printf('%.2f%%', (1 - z / (r * c)) * 100) AS sparsity
FROM (SELECT (SELECT count(*) FROM patchtable) AS r, (SELECT count(*) FROM lri) AS c, (SELECT count(*) FROM pmatrix) AS z,
      (SELECT count(*) FROM (SELECT gene FROM genes GROUP BY gene HAVING count(*) = 3)) AS g)""")
def _(t: Inputs):
    return interactions.matrix_stats(t.matrix(), occupied(t), interactions.shared_genes(t.genes()))


@query("agg_sample_info", """
SELECT sample_id, n_cells, count(*) AS n_patches, min(global_patch_idx) AS global_patch_idx_start, max(global_patch_idx) AS global_patch_idx_end
FROM (SELECT sample_id, global_patch_idx FROM patchtable) JOIN (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY ALL) USING (sample_id) GROUP BY ALL""")
def _(t: Inputs):
    cells = t.cells()
    return interactions.sample_info(cells, regions.patch_table(regions.assign_patches(cells)))


@query("agg_cells_per_patch", """
, h AS (SELECT n_cells, (SELECT min(n_cells) FROM patchtable) AS lo, (SELECT max(n_cells) FROM patchtable) AS hi FROM patchtable),
b AS (SELECT CAST(least(49, floor((n_cells - lo) / ((hi - lo) / 50))) AS INT) AS bin, count(*) AS n FROM h GROUP BY ALL)
SELECT b.bin, b.n, s.* FROM b, (SELECT count(*) AS n_patches, CAST(sum(n_cells) AS BIGINT) AS n_cells, round(avg(n_cells), 6) AS mean,
  median(n_cells) AS median, min(n_cells) AS min, max(n_cells) AS max FROM patchtable) s""")
def _(t: Inputs):
    stats_row, hist = regions.cells_per_patch(regions.patch_table(regions.assign_patches(t.cells())))
    from cellweave.session import with_each

    return with_each(hist.select("bin", "n"), stats_row.withColumn("mean", F.round("mean", 6)))


@query("agg_nbr_size", """
SELECT sample_id, n_cells, round(n / n_cells, 6) AS avg_neighborhood_size
FROM (SELECT sample_id, count(*) AS n FROM edges GROUP BY ALL) JOIN (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY ALL) USING (sample_id)""")
def _(t: Inputs):
    sizes = regions.average_neighborhood_size(t.cells())
    return sizes.select("sample_id", "n_cells", r6("avg_neighborhood_size", "avg_neighborhood_size"))


@query("agg_col_means", "SELECT lri_idx, round(sum(value) / (SELECT count(*) FROM patchtable), 6) AS mean FROM pmatrix JOIN lri USING (lr_id, celltype1, celltype2, mode) GROUP BY ALL")
def _(t: Inputs):
    indexed = interactions.indexed_matrix(t.matrix(), t.lri())
    return motifs.column_means(indexed, occupied(t)).select("lri_idx", r6("mean", "mean"))


base.CTE["prev"] = "SELECT ligand, receptor, sum(mean) AS lr_global_mean FROM lm WHERE motif = 0 GROUP BY ALL"
base.CTE["wmax"] = "SELECT motif, CASE WHEN max(loading) > 0 THEN max(loading) ELSE 1 END AS w_max FROM wload GROUP BY ALL"


@query("agg_lr_prevalence", "SELECT ligand, receptor, round(lr_global_mean, 6) AS lr_global_mean FROM prev")
def _(t: Inputs):
    return motifs.lr_prevalence(motif_table(t)).select("ligand", "receptor", r6("lr_global_mean", "lr_global_mean"))


@query("agg_lri_motifs", "SELECT lri_idx, motif, lri_name, round(factor, 6) AS factor, round(mean, 6) AS mean, celltype1, celltype2, ligand, receptor, signaling_type FROM lm")
def _(t: Inputs):
    return motif_table(t).withColumn("factor", F.round("factor", 6)).withColumn("mean", F.round("mean", 6))


@query("agg_scores", """
SELECT lri_idx, motif, round(w_max, 6) AS w_max, round(factor * w_max, 6) AS factor_rescaled, round(lr_global_mean, 6) AS lr_global_mean,
  round(factor / (lr_global_mean + 1), 6) AS factor_lrnorm, round(factor * w_max / (lr_global_mean + 1), 6) AS score
FROM lm JOIN prev USING (ligand, receptor) JOIN wmax USING (motif)""")
def _(t: Inputs):
    _, _, scales = factorize.rescale(t.patch_loadings(), t.factors())
    scored = motifs.add_scores(motif_table(t), scales)
    return scored.select("lri_idx", "motif", *[r6(c, c) for c in ("w_max", "factor_rescaled", "lr_global_mean", "factor_lrnorm", "score")])


@query("agg_rescale", "SELECT sample_id, region_id, motif, round(loading / w_max, 6) AS loading FROM wload JOIN wmax USING (motif)")
def _(t: Inputs):
    w2, _, _ = factorize.rescale(t.patch_loadings(), t.factors())
    return w2.select("sample_id", "region_id", "motif", r6("loading", "loading"))


@query("agg_rescale_check", """
, a AS (SELECT count(*) AS n, max(abs(loading / w_max * w_max - loading) / loading) AS e FROM wload JOIN wmax USING (motif)),
b AS (SELECT count(*) AS n, max(abs(factor * w_max - w_max * factor) / (factor * w_max)) AS e FROM factors JOIN wmax USING (motif))
SELECT a.n AS n_loadings, b.n AS n_factors, round(a.e + b.e, 9) AS rel_err FROM a, b""")
def _(t: Inputs):
    w, v = t.patch_loadings(), t.factors()
    w2, v2, scales = factorize.rescale(w, v)
    err = factorize.reconstruction_error(w, v, w2, v2, scales, ["sample_id", "region_id"])
    return err.select("n_loadings", "n_factors", r6("rel_err", "rel_err"))


@query("agg_top_motifs", """
SELECT motif, round(activity, 6) AS activity, round(activity / sum(activity) OVER (), 6) AS fraction
FROM (SELECT motif, sum(loading) AS activity FROM wload GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY activity DESC, motif) <= 3""")
def _(t: Inputs):
    return factorize.top_motifs(t.patch_loadings(), 3).select("motif", r6("activity", "activity"), r6("fraction", "fraction"))


@query("agg_diagnostics", """
, d AS (SELECT motif, sum(loading) / max(loading) AS coverage, sum(loading) * sv AS contribution
  FROM wload JOIN (SELECT motif, sum(factor) AS sv FROM factors GROUP BY ALL) USING (motif) GROUP BY motif, sv)
SELECT motif, round(coverage, 6) AS coverage, round(coverage / (sum(coverage) OVER () + 1e-10), 6) AS coverage_fraction,
  round(contribution, 4) AS contribution, round(contribution / (sum(contribution) OVER () + 1e-10), 6) AS contribution_fraction FROM d""")
def _(t: Inputs):
    d = motifs.diagnostics(t.patch_loadings(), t.factors())
    return d.select("motif", r6("coverage", "coverage"), r6("coverage_fraction", "coverage_fraction"),
                    F.round("contribution", 4).alias("contribution"), r6("contribution_fraction", "contribution_fraction"))


def _hist_sql(table: str, value: str, bins: int, name: str) -> str:
    return f"""SELECT '{name}' AS matrix, CAST(least({bins - 1}, floor((v - v_lo) / ((v_hi - v_lo) / {bins}))) AS INT) AS bin, count(*) AS n
    FROM (SELECT *, min(v) OVER () AS v_lo, max(v) OVER () AS v_hi FROM (SELECT {value} AS v FROM {table})) GROUP BY ALL"""


@query("agg_diagnostics_hist", _hist_sql("wload", "ln(loading + 1e-10)", 50, "loadings") + " UNION ALL " + _hist_sql("factors", "ln(factor + 1e-10)", 50, "factors"))
def _(t: Inputs):
    h = lambda df, c, name: motifs.histogram(df, F.log(F.col(c) + 1e-10), 50).select(F.lit(name).alias("matrix"), "bin", "n")
    return h(t.patch_loadings(), "loading", "loadings").unionByName(h(t.factors(), "factor", "factors"))


@query("agg_factor_dist", _hist_sql("(SELECT sum(factor) AS f FROM factors GROUP BY lri_idx)", "f", 100, "columns")
       + " UNION ALL " + _hist_sql("(SELECT sum(loading) AS f FROM wload GROUP BY sample_id, region_id)", "f", 100, "regions"))
def _(t: Inputs):
    by_col, by_row = motifs.participation(t.patch_loadings(), t.factors(), ["sample_id", "region_id"])
    return by_col.select(F.lit("columns").alias("matrix"), "bin", "n").unionByName(by_row.select(F.lit("regions").alias("matrix"), "bin", "n"))


@query("agg_factor_sparsity", """
SELECT 'loadings' AS matrix, round(avg(CAST(loading < 0.3 AS INT)), 6) AS share FROM wload
UNION ALL SELECT 'factors', round(avg(CAST(factor < 0.3 AS INT)), 6) FROM factors""")
def _(t: Inputs):
    return motifs.sparsity(t.patch_loadings(), t.factors(), 0.3).select("matrix", r6("share", "share"))


@query("agg_factor_scatter", """
SELECT lri_idx, motif, round(factor, 6) AS x, round(lr_global_mean, 6) AS y FROM lm JOIN prev USING (ligand, receptor) WHERE motif = 2""")
def _(t: Inputs):
    _, _, scales = factorize.rescale(t.patch_loadings(), t.factors())
    return motifs.factor_scatter(motifs.add_scores(motif_table(t), scales), 2).select("lri_idx", "motif", r6("x", "x"), r6("y", "y"))


@query("agg_pair_matrix", "SELECT celltype1 || '|' || celltype2 AS cell_pair, " + ", ".join(
    f"round(coalesce(sum(factor) FILTER (motif = {k}), 0), 6) AS motif_{k}" for k in range(K)) + " FROM lm GROUP BY ALL")
def _(t: Inputs):
    m = motifs.pair_matrix(motif_table(t), list(range(K)))
    return m.select("cell_pair", *[r6(f"motif_{k}", f"motif_{k}") for k in range(K)])


@query("agg_comm_matrix", "SELECT motif, celltype1, " + ", ".join(
    f"round(coalesce(sum(factor) FILTER (celltype2 = '{c}'), 0), 6) AS \"{c}\"" for c in CELL_TYPES) + " FROM lm GROUP BY motif, celltype1")
def _(t: Inputs):
    m = motifs.communication_matrix(motif_table(t), CELL_TYPES)
    return m.select("motif", "celltype1", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in CELL_TYPES])


base.CTE["lmp"] = "SELECT lm.*, u.pathway FROM lm JOIN lrusable u USING (ligand, receptor)"


@query("agg_pathway", """
, f AS (SELECT motif, celltype1, celltype2, pathway, sum(factor) AS weight FROM lmp GROUP BY ALL),
lg AS (SELECT motif, celltype1, celltype2, pathway, string_agg(g, ', ' ORDER BY o) AS ligands FROM (
  SELECT * FROM (SELECT motif, celltype1, celltype2, pathway, ligand AS g, min(lri_idx) AS o FROM lmp GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY motif, celltype1, celltype2, pathway ORDER BY o) <= 2) GROUP BY ALL),
rg AS (SELECT motif, celltype1, celltype2, pathway, string_agg(g, ', ' ORDER BY o) AS receptors FROM (
  SELECT * FROM (SELECT motif, celltype1, celltype2, pathway, receptor AS g, min(lri_idx) AS o FROM lmp GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY motif, celltype1, celltype2, pathway ORDER BY o) <= 2) GROUP BY ALL)
SELECT motif, celltype1, celltype2, pathway, round(weight, 6) AS weight, ligands, receptors,
  CAST(row_number() OVER (PARTITION BY motif ORDER BY weight DESC, celltype1, celltype2, pathway) AS INT) AS rank
FROM f JOIN lg USING (motif, celltype1, celltype2, pathway) JOIN rg USING (motif, celltype1, celltype2, pathway)
QUALIFY rank <= 12""")
def _(t: Inputs):
    named = lrdb.annotate_pathways(motif_table(t), t.pairs())
    return motifs.pathway_totals(named, 12).withColumn("weight", F.round("weight", 6))


WEIGHTS = "SELECT motif, cell_type, sum(loading) AS weight FROM loadings JOIN cells USING (sample_id, cell_id) WHERE cell_type IS NOT NULL GROUP BY ALL"


@query("agg_ct_weight", f"""
, w AS ({WEIGHTS}), r AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY weight DESC, cell_type) AS rn FROM w),
o AS (SELECT motif, CASE WHEN rn > 3 THEN 'Other' ELSE cell_type END AS cell_type, sum(weight) AS weight FROM r GROUP BY ALL)
SELECT motif, cell_type, round(weight / sum(weight) OVER (PARTITION BY motif), 6) AS weight FROM o""")
def _(t: Inputs):
    return states.celltype_weights(t.loadings(), t.cells(), True, 3).select("motif", "cell_type", r6("weight", "weight"))


@query("agg_ct_wide", f", w AS ({WEIGHTS}) SELECT motif, " + ", ".join(
    f"round(coalesce(sum(weight) FILTER (cell_type = '{c}'), 0), 6) AS \"{c}\"" for c in CELL_TYPES) + " FROM w GROUP BY motif")
def _(t: Inputs):
    wide = states.wide_weights(states.celltype_weights(t.loadings(), t.cells(), normalize=False))
    return wide.select("motif", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns[1:]])


@query("agg_state_counts", "SELECT motif, count(*) FILTER (state = 'positive') AS positive, count(*) FILTER (state = 'negative') AS negative FROM states GROUP BY ALL")
def _(t: Inputs):
    return states.state_counts(t.states())


@query("agg_pos_per_cell", f"""
SELECT range AS n_positive, coalesce(n, 0) AS n_cells FROM range({K + 1}) LEFT JOIN (
  SELECT p, count(*) AS n FROM (SELECT count(*) FILTER (state = 'positive') AS p FROM states GROUP BY sample_id, cell_id) GROUP BY p) ON p = range""")
def _(t: Inputs):
    return states.positive_motifs_per_cell(t.states(), K)


@query("agg_pos_ct", """
SELECT motif, cell_type, round(n / sum(n) OVER (PARTITION BY motif), 6) AS weight FROM (
  SELECT motif, cell_type, count(*) AS n FROM states JOIN cells USING (sample_id, cell_id)
  WHERE state = 'positive' AND cell_type IS NOT NULL GROUP BY ALL)""")
def _(t: Inputs):
    return states.positive_celltypes(t.states(), t.cells(), normalize=True).select("motif", "cell_type", r6("weight", "weight"))


@query("agg_pos_ct_untyped", """
SELECT motif, coalesce(cell_type, 'nan') AS cell_type, count(*) AS weight FROM states JOIN cells USING (sample_id, cell_id)
WHERE state = 'positive' AND motif IN (0, 2) GROUP BY ALL""")
def _(t: Inputs):
    return states.positive_celltypes(t.states(), t.cells(), motif_ids=[0, 2], include_untyped=True)


base.CTE["oncells"] = "SELECT sample_id, cell_id, bool_and(state = 'positive') AS is_on FROM states WHERE motif IN (0, 3) GROUP BY ALL"


@query("agg_spatial_state", """
SELECT sample_id, count(*) FILTER (is_on) AS n_pos, count(*) FILTER (NOT is_on) AS n_neg, round(count(*) FILTER (is_on) / count(*) * 100, 6) AS pct_on
FROM oncells GROUP BY ROLLUP (sample_id)""")
def _(t: Inputs):
    return states.on_summary(t.states(), [0, 3]).withColumn("pct_on", F.round("pct_on", 6))


@query("agg_spatial_state_types", """
SELECT cell_type, count(*) AS n FROM states JOIN cells USING (sample_id, cell_id) WHERE motif = 1 AND state = 'positive' AND cell_type IS NOT NULL
GROUP BY ALL ORDER BY n DESC, cell_type LIMIT 3""")
def _(t: Inputs):
    return states.on_celltypes(t.states(), t.cells(), [1], 3)


GROUPS = """sample_id, cell_id, 'P' || CAST(cell_id % 11 AS STRING) AS "group", CASE WHEN cell_id % 11 % 2 = 0 THEN 'low' ELSE 'high' END AS grade"""
base.CTE["groupfrac"] = f"""
  SELECT motif, "group", count(*) FILTER (state = 'positive') AS n_positive, count(*) AS n_cells, min(grade) AS grade,
         count(*) FILTER (state = 'positive') / count(*) AS fraction
  FROM states JOIN (SELECT {GROUPS} FROM cells) USING (sample_id, cell_id) GROUP BY ALL"""


def group_table(t: Inputs):
    p = F.col("cell_id") % 11
    return t.cells().select(
        "sample_id", "cell_id", F.concat(F.lit("P"), p.cast("string")).alias("group"),
        F.when(p % 2 == 0, "low").otherwise("high").alias("grade"),
    )


@query("agg_group_fraction", 'SELECT motif, "group", n_positive, n_cells, grade, round(fraction, 6) AS fraction FROM groupfrac')
def _(t: Inputs):
    return states.group_fractions(t.states(), group_table(t)).withColumn("fraction", F.round("fraction", 6))


@query("agg_group_fraction_test", f"""
, r AS (SELECT motif, grade, rank() OVER (PARTITION BY motif ORDER BY fraction) + (count(*) OVER (PARTITION BY motif, fraction) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY motif, fraction) AS t FROM groupfrac),
s AS (SELECT motif, count(*) FILTER (grade = 'high') AS n1, count(*) FILTER (grade = 'low') AS n2, sum(t * t - 1) AS ties, max(t) > 1 AS tied,
  sum(rk) FILTER (grade = 'high') - count(*) FILTER (grade = 'high') * (count(*) FILTER (grade = 'high') + 1) / 2 AS u1 FROM r GROUP BY ALL),
z AS (SELECT *, greatest(u1, n1 * n2 - u1) AS u, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM s),
-- Every way to deal the ranks of the eleven groups to the two grades.
deals AS (SELECT k, list_sum([CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END for i in range(0, 11)]) - k * (k + 1) / 2 AS u FROM (SELECT m, CAST(bit_count(m) AS BIGINT) AS k FROM range(2048) d(m))),
x AS (SELECT motif, least(1, 2 * count(*) FILTER (deals.u >= z.u) / count(*)) AS p FROM z JOIN deals ON k = n1 GROUP BY motif)
SELECT motif, n1, n2, u1, round(CASE WHEN NOT tied AND least(n1, n2) <= 8 THEN p WHEN z IS NULL OR z <= 0 THEN 1 ELSE {two_sided("z")} END, 6) AS pval FROM z JOIN x USING (motif)""")
def _(t: Inputs):
    tested = states.compare_grades(states.group_fractions(t.states(), group_table(t)), "low", "high")
    return tested.withColumn("pval", F.round("pval", 6))


@query("agg_expr_frac", """
SELECT cell_type, gene, n AS n_expr, round(n / nc, 6) AS fraction FROM dn
JOIN (SELECT cell_type, count(*) AS nc FROM cells WHERE cell_type IS NOT NULL GROUP BY ALL) USING (cell_type)""")
def _(t: Inputs):
    return stats.expression_fraction(t.cells(), t.expression()).withColumn("fraction", F.round("fraction", 6))


@query("agg_marker_summary", """
SELECT c.cell_type, count(m.gene) AS n_marker_genes, round(count(m.gene) / (SELECT count(*) FROM panel) * 100, 6) AS marker_percentage
FROM (SELECT DISTINCT cell_type FROM cells WHERE cell_type IS NOT NULL) c LEFT JOIN markers m USING (cell_type) GROUP BY ALL""")
def _(t: Inputs):
    types = readers.typed_cells(t.cells()).select("cell_type").distinct()
    return stats.marker_summary(marker_rows(t), types, t.panel()).withColumn("marker_percentage", F.round("marker_percentage", 6))


base.CTE["netedges"] = """
  SELECT motif, celltype1, celltype2, sum(factor) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY motif ORDER BY factor DESC, lri_idx) AS rn FROM lm) WHERE rn <= 40 GROUP BY ALL"""


@query("agg_network", """
SELECT motif, celltype1, celltype2, round(weight, 6) AS weight, lr_text, round(min(weight) OVER (), 6) AS min_weight, round(max(weight) OVER (), 6) AS max_weight
FROM netedges JOIN (SELECT motif, celltype1, celltype2,
  string_agg(ligand || '-' || receptor || ':' || signaling_type, ';' ORDER BY factor DESC, lri_idx) AS lr_text FROM lm GROUP BY ALL) USING (motif, celltype1, celltype2)""")
def _(t: Inputs):
    edges, _ = motifs.network(motif_table(t), 40)
    text = F.transform("lr_pairs", lambda p: F.concat(p["ligand"], F.lit("-"), p["receptor"], F.lit(":"), p["mode"]))
    return edges.select(
        "motif", "celltype1", "celltype2", r6("weight", "weight"), F.array_join(text, ";").alias("lr_text"),
        r6("min_weight", "min_weight"), r6("max_weight", "max_weight"),
    )


@query("agg_network_nodes", """
SELECT DISTINCT motif, cell_type FROM (SELECT motif, unnest([celltype1, celltype2]) AS cell_type FROM netedges)""")
def _(t: Inputs):
    return motifs.network(motif_table(t), 40)[1]


@query("set_shared_genes", "SELECT gene FROM genes GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM genes)")
def _(t: Inputs):
    return interactions.shared_genes(t.genes())


@query("set_all_celltypes", "SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY ALL")
def _(t: Inputs):
    types, untyped = interactions.all_celltypes(t.cells())
    return types.unionByName(untyped)


@query("set_split_samples", """
SELECT sample_id, count(*) AS n_cells, CAST(sum(cell_id) AS BIGINT) AS id_sum FROM (
  SELECT CASE WHEN cell_id % 10 = 0 THEN NULL ELSE sample_id END AS sample_id, cell_id FROM cells) WHERE sample_id IS NOT NULL GROUP BY ALL""")
def _(t: Inputs):
    merged = t.cells().withColumn("sample_id", F.when(F.col("cell_id") % 10 != 0, F.col("sample_id")))
    kept = interactions.with_sample(merged, "sample_id")
    return kept.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.sum("cell_id").alias("id_sum"))


@query("set_stack_samples", "SELECT * FROM cells UNION ALL SELECT 'T' || sample_id, cell_id, y, x, cell_type FROM cells WHERE sample_id = 'S1'")
def _(t: Inputs):
    c = t.cells()
    other = c.where("sample_id = 'S1'").select(
        F.concat(F.lit("T"), "sample_id").alias("sample_id"), "cell_id", "cell_type", F.col("y").alias("x"), F.col("x").alias("y")
    )
    return interactions.stack_samples([c, other])


@query("set_gene_overlap", """
, b AS (SELECT DISTINCT gene FROM partgenes WHERE gene <> '')
SELECT (SELECT count(*) FROM panel WHERE gene NOT IN (SELECT gene FROM b)) AS data_only,
  (SELECT count(*) FROM b WHERE gene NOT IN (SELECT gene FROM panel)) AS db_only,
  (SELECT count(*) FROM b WHERE gene IN (SELECT gene FROM panel)) AS both, (SELECT count(*) FROM b) AS n_db,
  round((SELECT count(*) FROM b WHERE gene IN (SELECT gene FROM panel)) / (SELECT count(*) FROM b) * 100, 6) AS pct_coverage""")
def _(t: Inputs):
    return lrdb.gene_overlap(t.panel(), t.part_lr()).withColumn("pct_coverage", F.round("pct_coverage", 6))


@query("set_pair_overlap", """
SELECT count(*) AS n_pairs, count(*) FILTER (ligand_ok) AS ligand_covered, count(*) FILTER (receptor_ok) AS receptor_covered,
  count(*) FILTER (ligand_ok AND receptor_ok) AS both, count(*) FILTER (ligand_ok AND NOT receptor_ok) AS only_ligand,
  count(*) FILTER (NOT ligand_ok AND receptor_ok) AS only_receptor, count(*) FILTER (NOT ligand_ok AND NOT receptor_ok) AS neither,
  round(count(*) FILTER (ligand_ok AND receptor_ok) / count(*) * 100, 6) AS pct_usable FROM partcov""")
def _(t: Inputs):
    return lrdb.pair_overlap(t.part_lr(), t.panel()).withColumn("pct_usable", F.round("pct_usable", 6))
