"""Registered queries: the five batch stages, end to end through their stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import K, Inputs, query, r6
from catalog.scalars import motif_table
from catalog.sources import de_rows
from cellweave.plans import jobs
from cellweave.session import scratch_path

# Pairs over the genes all samples share (one gene is missing from one sample, and no
# registered pair uses it, so the columns equal those of the full panel).
STEPS = 3


def patches(t: Inputs) -> tuple[str, dict]:
    out = scratch_path(t.spark, "patchify")
    return out, jobs.patchify(t.cells(), t.expression(), t.genes(), t.lr(), out)


@query("job_patchify", """
SELECT 'patch_size' AS parameter, '50.0' AS value FROM (SELECT count(*) FROM cells)
UNION ALL SELECT 'n_patches', CAST(count(*) AS VARCHAR) FROM patchtable
UNION ALL SELECT 'n_lri_combinations', CAST(count(*) AS VARCHAR) FROM lri
UNION ALL SELECT 'matrix_sparsity', printf('%.2f%%', (1 - (SELECT count(*) FROM pmatrix) / ((SELECT count(*) FROM patchtable) * (SELECT count(*) FROM lri))) * 100)
UNION ALL SELECT 'n_shared_genes', CAST(count(*) AS VARCHAR) FROM (SELECT gene FROM genes GROUP BY gene HAVING count(*) = 3)""")
def _(t: Inputs):
    return t.spark.read.parquet(patches(t)[1]["parameters"])


@query("job_factorize", f"SELECT motif, count(*) AS n_columns, true AS positive FROM lri, (SELECT CAST(range AS INT) AS motif FROM range({K})) GROUP BY ALL")
def _(t: Inputs):
    patch_dir, _ = patches(t)
    out = jobs.factorize_patches(t.spark, patch_dir, scratch_path(t.spark, "factorize"), t.lr(), K, STEPS)
    table = t.spark.read.parquet(out["lri_motifs"])
    return table.groupBy("motif").agg(F.count("*").alias("n_columns"), F.every(F.col("score") > 0).alias("positive"))


@query("job_project", f"SELECT motif, count(*) AS n_cells, true AS positive FROM cells, (SELECT CAST(range AS INT) AS motif FROM range({K})) GROUP BY ALL")
def _(t: Inputs):
    patch_dir, _ = patches(t)
    model_dir = scratch_path(t.spark, "factorize")
    jobs.factorize_patches(t.spark, patch_dir, model_dir, t.lr(), K, STEPS)
    out = jobs.project_cells(t.cells(), t.expression(), t.genes(), t.lr(), patch_dir, model_dir, scratch_path(t.spark, "project"), 20)
    loadings = t.spark.read.parquet(out["loadings"])
    return loadings.groupBy("motif").agg(F.count("*").alias("n_cells"), F.every(F.col("loading") > 0).alias("positive"))


@query("job_de", "SELECT motif, cell_type, gene, round(logfc, 6) AS logfc, round(qval, 6) AS qval FROM derun")
def _(t: Inputs):
    out = jobs.differential_expression(
        t.loadings(), t.cells(), t.expression(), t.genes(), t.lri(), scratch_path(t.spark, "de"), spearman_threshold=0.5
    )
    return t.spark.read.parquet(out["de"]).select("motif", "cell_type", "gene", r6("logfc", "logfc"), r6("qval", "qval"))


@query("job_report", """
SELECT 'top_interactions' AS name, count(*) AS n_rows FROM (SELECT 1 FROM bestlri QUALIFY row_number() OVER (PARTITION BY motif ORDER BY factor DESC, lri_idx) <= 20)
UNION ALL SELECT 'celltype_weights', count(*) FROM (SELECT DISTINCT motif, cell_type FROM loadings JOIN cells USING (sample_id, cell_id) WHERE cell_type IS NOT NULL)
UNION ALL SELECT 'states', count(*) FROM loadings
UNION ALL SELECT 'activities', count(DISTINCT motif) FROM wload
UNION ALL SELECT 'factor_scatter', count(*) FROM lm
UNION ALL SELECT 'diagnostics', count(DISTINCT motif) FROM wload
UNION ALL SELECT 'spatial_state_1', count(DISTINCT sample_id) + 1 FROM loadings""")
def _(t: Inputs):
    out = jobs.report(
        t.cells(), t.expression(), t.genes(), t.loadings(), motif_table(t), de_rows(t), scratch_path(t.spark, "report"),
        patch_loadings=t.patch_loadings(), factors=t.factors(),
    )
    names = ("top_interactions", "celltype_weights", "states", "activities", "factor_scatter", "diagnostics", "spatial_state_1")
    rows = [t.spark.read.parquet(out[n]).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in names]
    return reduce(DataFrame.unionByName, rows)
