"""Registered queries: readers and writers. Sinks are written to the shared folder and
read back, so the comparison covers the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import K, Inputs, _columns, query, r6
from cellweave import schema as S
from cellweave.operators import factorize, interactions, lrdb, regions
from cellweave.session import cut_lineage, scratch_path
from cellweave.sources import readers, writers

CELL_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

SHEET = """
    CASE WHEN o_orderkey % 7 = 0 THEN 'bad id ' || o_orderkey ELSE 'S' || o_orderkey END AS sample_id,
    CASE WHEN o_orderkey % 5 = 0 THEN '/data/s' || o_orderkey || '.txt' ELSE '/data/s' || o_orderkey || '.parquet' END AS data_path"""


@query("src_samplesheet", f"""
SELECT * FROM (SELECT {SHEET} FROM orders) WHERE regexp_matches(sample_id, '^\\S+$') AND regexp_matches(data_path, '^\\S+\\.(parquet|csv)$')""")
def _(t: Inputs):
    path = scratch_path(t.spark, "sheet")
    t.table("orders").selectExpr(*_columns(SHEET)).write.csv(path, header=True)
    return readers.read_samplesheet(t.spark, path)[0]


@query("src_cells", "SELECT * FROM cells")
def _(t: Inputs):
    path = scratch_path(t.spark, "cells")
    t.cells().withColumnRenamed("cell_type", "annotation").write.partitionBy("sample_id").parquet(path)
    return readers.read_cells(t.spark, path, "annotation")


@query("src_layer", """
SELECT 'S' || CAST(l_orderkey % 3 AS STRING) AS sample_id, l_orderkey AS cell_id,
       'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0') AS gene, count(*) AS count FROM lineitem GROUP BY ALL""")
def _(t: Inputs):
    gene = "'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0')"
    layers = t.table("lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.expr(gene).alias("gene")).agg(
        F.sum("l_quantity").cast("long").alias("X"), F.count("*").alias("counts")
    ).unpivot(["cell_id", "gene"], ["X", "counts"], "layer", "count")
    layers = layers.select(F.expr("'S' || CAST(cell_id % 3 AS STRING)").alias("sample_id"), "cell_id", "gene", "layer", "count")
    path = writers.write_facts(layers, scratch_path(t.spark, "layers"), ["layer"])
    stored = t.spark.read.schema(S.EXPRESSION).parquet(path)
    return readers.select_layer(stored, "layers:counts").select("sample_id", "cell_id", "gene", "count")


@query("src_lrdb", "SELECT CAST(lr_id AS INT) AS lr_id, ligand, receptor, coalesce(signaling_type, 'Unknown') AS signaling_type, pathway FROM partlr")
def _(t: Inputs):
    path = writers.write_facts(t.part_lr(), scratch_path(t.spark, "lrdb"))
    return readers.normalize_lr(t.spark.read.schema(S.LR_PAIRS).parquet(path))


@query("src_filter_nonnull_ct", "SELECT * FROM cells WHERE cell_type IS NOT NULL")
def _(t: Inputs):
    return readers.typed_cells(t.cells())


def _stored_patches(t: Inputs, part: str):
    # The matrix, its columns and the patches are stored once; several tables are made of each.
    cells, matrix, columns = t.cells(), t.matrix(), t.lri()
    patches = cut_lineage(regions.patch_table(regions.assign_patches(cells)))
    stats_row = interactions.matrix_stats(matrix, patches.agg(F.count("*").alias("n_regions")), t.panel())
    out = writers.write_region_matrix(
        interactions.indexed_matrix(matrix, columns), columns, stats_row, patches,
        interactions.sample_info(cells, patches), scratch_path(t.spark, "patches"),
    )
    return readers.read_results(t.spark, out[part])


@query("sink_patch_lri", "SELECT sample_id, region_id, lri_idx, value FROM pmatrix JOIN lri USING (lr_id, celltype1, celltype2, mode)")
def _(t: Inputs):
    return _stored_patches(t, "matrix")


@query("src_patch_lri", "SELECT lr_id, celltype1, celltype2, ligand, receptor, mode, lri_idx, lri_name FROM lri")
def _(t: Inputs):
    return _stored_patches(t, "columns")


def _stored_cells(t: Inputs, part: str):
    cells, pairs = t.cells(), t.pairs()
    matrix = interactions.cell_lri(cells, t.expression(), pairs)
    info = regions.average_neighborhood_size(cells)
    path = scratch_path(t.spark, "cells")
    if part == "sample_info":
        return readers.read_results(t.spark, writers.write_facts(info, f"{path}/sample_info"))
    # The rows of a task are of one tile after another: each file keeps few samples without an exchange.
    return readers.read_results(t.spark, writers.write_facts(matrix, f"{path}/cell_lri_matrix"))


@query("sink_cell_lri", "SELECT * FROM nmatrix")
def _(t: Inputs):
    return _stored_cells(t, "matrix")


@query("src_cell_lri", "SELECT sample_id, region_id, count(*) AS n_columns, CAST(sum(value) AS BIGINT) AS total FROM nmatrix GROUP BY ALL")
def _(t: Inputs):
    stored = _stored_cells(t, "matrix")
    return stored.groupBy("sample_id", "region_id").agg(F.count("*").alias("n_columns"), F.sum("value").cast("long").alias("total"))


@query("src_cell_info", """
SELECT sample_id, n_cells, round(n / n_cells, 6) AS avg_neighborhood_size
FROM (SELECT sample_id, count(*) AS n FROM edges GROUP BY ALL) JOIN (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY ALL) USING (sample_id)""")
def _(t: Inputs):
    return _stored_cells(t, "sample_info").select("sample_id", "n_cells", r6("avg_neighborhood_size", "avg_neighborhood_size"))


@query("sink_factors", "SELECT motif, lri_idx, round(factor * w_max, 6) AS factor FROM factors JOIN (SELECT motif, max(loading) AS w_max FROM wload GROUP BY ALL) USING (motif)")
def _(t: Inputs):
    _, v2, _ = factorize.rescale(t.patch_loadings(), t.factors())
    path = writers.write_facts(v2, scratch_path(t.spark, "factors"), ["motif"])
    return readers.read_results(t.spark, path).select("motif", "lri_idx", r6("factor", "factor"))


@query("src_factors", "SELECT sample_id, region_id, motif, loading FROM wload")
def _(t: Inputs):
    path = writers.write_facts(t.patch_loadings(), scratch_path(t.spark, "factors"), ["motif"])
    return readers.read_results(t.spark, path).select("sample_id", "region_id", "motif", "loading")


@query("sink_cell_loadings", "SELECT sample_id, cell_id, " + ", ".join(
    f"max(loading) FILTER (motif = {k}) AS motif_{k}" for k in range(K)) + " FROM loadings GROUP BY ALL")
def _(t: Inputs):
    wide = writers.wide_loadings(t.loadings(), list(range(K)))
    return readers.read_results(t.spark, writers.write_facts(wide, scratch_path(t.spark, "loadings")))


# Stand-in results, one row per (motif, type, gene) that occurs.
DE_ROWS = """
    motif, cell_type, gene,
    CAST((n * 7 + motif * 13) % 41 - 20 AS DOUBLE) / 16 AS logfc,
    CAST((n * 3 + motif) % 9 + 1 AS DOUBLE) / 32 AS se,
    CASE WHEN n % 19 = 0 THEN 0.0 ELSE CAST((n * 11 + motif * 5) % 1009 + 1 AS DOUBLE) / 1024 END AS pval,
    CASE WHEN n % 19 = 0 THEN 0.0 WHEN n % 23 = 0 THEN NULL ELSE CAST((n * n + motif * 29) % 997 + 1 AS DOUBLE) / 4096 END AS qval"""


def de_rows(t: Inputs):
    seen = t.expression().join(readers.typed_cells(t.cells()), ["sample_id", "cell_id"])
    counts = seen.groupBy("cell_type", "gene").agg(F.count("*").alias("n"))
    ks = F.explode(F.array(*[F.lit(k) for k in range(K)])).alias("motif")
    return counts.select("cell_type", "gene", "n", ks).selectExpr(*_columns(DE_ROWS))


from catalog import base  # noqa: E402

base.CTE["dn"] = "SELECT cell_type, gene, count(*) AS n FROM cells JOIN expression USING (sample_id, cell_id) WHERE cell_type IS NOT NULL GROUP BY ALL"
base.CTE["de"] = f"SELECT {DE_ROWS} FROM (SELECT dn.*, k AS motif FROM dn, ks)"


@query("sink_de", "SELECT motif, cell_type, gene, logfc, se, pval, qval FROM de")
def _(t: Inputs):
    path = writers.write_de(de_rows(t), scratch_path(t.spark, "de"))
    return readers.read_results(t.spark, path).select("motif", "cell_type", "gene", "logfc", "se", "pval", "qval")


@query("src_de", "SELECT motif, cell_type, gene, qval FROM de WHERE motif = 2 AND cell_type = '1-URGENT'")
def _(t: Inputs):
    path = writers.write_de(de_rows(t), scratch_path(t.spark, "de"))
    stored = readers.read_results(t.spark, path)
    return stored.where("motif = 2 AND cell_type = '1-URGENT'").select("motif", "cell_type", "gene", "qval")


base.CTE["markers"] = "SELECT cell_type, gene FROM dn WHERE n % 5 = 0"


def marker_rows(t: Inputs):
    seen = t.expression().join(readers.typed_cells(t.cells()), ["sample_id", "cell_id"])
    return seen.groupBy("cell_type", "gene").agg(F.count("*").alias("n")).where("n % 5 = 0").select("cell_type", "gene")


@query("sink_mask", "SELECT gene, " + ", ".join(
    f"CAST(coalesce(max(CASE WHEN cell_type = '{c}' THEN 1 END), 0) AS INT) AS \"{c}\"" for c in CELL_TYPES)
    + " FROM panel LEFT JOIN markers USING (gene) GROUP BY gene")
def _(t: Inputs):
    wide = writers.wide_mask(marker_rows(t), t.panel(), CELL_TYPES)
    return readers.read_results(t.spark, writers.write_facts(wide, scratch_path(t.spark, "mask")))


@query("src_mask", """
SELECT p.gene, c.cell_type, m.gene IS NOT NULL AS is_marker
FROM panel p CROSS JOIN (SELECT DISTINCT cell_type FROM cells WHERE cell_type IS NOT NULL) c
LEFT JOIN markers m ON m.gene = p.gene AND m.cell_type = c.cell_type""")
def _(t: Inputs):
    known = t.panel().where("gene <> 'G05'")
    wide = writers.wide_mask(marker_rows(t), known, CELL_TYPES)
    stored = readers.read_results(t.spark, writers.write_facts(wide, scratch_path(t.spark, "mask")))
    return readers.read_mask(stored, t.panel(), CELL_TYPES)


base.SQL["src_mask"] = base.sql("""
SELECT p.gene, c.cell_type, m.gene IS NOT NULL AND p.gene <> 'G05' AS is_marker
FROM panel p CROSS JOIN (SELECT DISTINCT cell_type FROM cells WHERE cell_type IS NOT NULL) c
LEFT JOIN markers m ON m.gene = p.gene AND m.cell_type = c.cell_type""")


@query("sink_db_genes", "SELECT DISTINCT gene FROM partgenes WHERE gene <> ''")
def _(t: Inputs):
    path = scratch_path(t.spark, "genes")
    lrdb.database_genes(t.part_lr()).orderBy("gene").write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "gene")
