"""Registered queries: scalar functions, filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import RAW_GENES, RAW_NAMES, Inputs, _columns, query, r6
from catalog.sources import de_rows
from cellweave.functions import names
from cellweave.operators import de, interactions, lrdb, motifs, regions, stats
from cellweave.sources import readers


def raw_names(t: Inputs):
    return t.table("lineitem").selectExpr(*_columns(RAW_GENES)).selectExpr(*_columns(RAW_NAMES))


@query("fn_split_complex", "SELECT lr_id, array_to_string(string_split(replace(ligand, ',', '_'), '_'), ' ') AS genes FROM partlr WHERE ligand IS NOT NULL")
def _(t: Inputs):
    return t.part_lr().where("ligand IS NOT NULL").select("lr_id", F.array_join(names.split_complex(F.col("ligand")), " ").alias("genes"))


@query("fn_database_genes", "SELECT DISTINCT gene FROM partgenes WHERE gene <> ''")
def _(t: Inputs):
    return lrdb.database_genes(t.part_lr())


@query("fn_lri_name", "SELECT sample_id, region_id, concat_ws('|', celltype1, celltype2, ligand, receptor, mode) AS lri_name, value FROM pmatrix JOIN lrusable USING (lr_id)")
def _(t: Inputs):
    return interactions.named_matrix(t.matrix(), t.pairs())


PARSED = """
SELECT l_orderkey, l_linenumber, lri_name,
  CASE WHEN n >= 4 THEN p[1] ELSE 'unknown' END AS celltype1, CASE WHEN n >= 4 THEN p[2] ELSE 'unknown' END AS celltype2,
  CASE WHEN n >= 4 THEN p[3] WHEN n = 2 THEN p[1] ELSE lri_name END AS ligand,
  CASE WHEN n >= 4 THEN p[4] WHEN n = 2 THEN p[2] ELSE lri_name END AS receptor,
  CASE WHEN n >= 5 THEN p[5] WHEN n = 4 AND p[1] = p[2] THEN 'autocrine' WHEN n = 4 THEN 'paracrine' ELSE 'unknown' END AS signaling_type
FROM (SELECT *, string_split(lri_name, '|') AS p, len(string_split(lri_name, '|')) AS n FROM rawnames)"""


@query("fn_parse_lri", PARSED)
def _(t: Inputs):
    return raw_names(t).select("*", names.parse_lri(F.col("lri_name")).alias("p")).select("l_orderkey", "l_linenumber", "lri_name", "p.*")


@query("fn_lri_components", PARSED + " WHERE NOT starts_with(lri_name, 'GENE')")
def _(t: Inputs):
    return names.add_lri_components(raw_names(t))


MODE_TEXT = """l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN ' Auto ' WHEN 1 THEN 'AUTOCRINE' WHEN 2 THEN 'a' WHEN 3 THEN 'Juxta'
    WHEN 4 THEN 'j ' WHEN 5 THEN 'juxtacrine' ELSE l_returnflag END AS raw_mode"""


@query("fn_norm_mode", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(raw_mode)) IN ('auto', 'autocrine', 'a') THEN 'autocrine'
  WHEN lower(trim(raw_mode)) IN ('juxta', 'juxtacrine', 'j') THEN 'juxtacrine' ELSE 'paracrine' END AS mode
FROM (SELECT {MODE_TEXT} FROM lineitem)""")
def _(t: Inputs):
    raw = t.table("lineitem").selectExpr(*_columns(MODE_TEXT))
    return raw.select("l_orderkey", "l_linenumber", names.norm_mode(F.col("raw_mode")).alias("mode"))


@query("fn_extract_lri_genes", """
SELECT DISTINCT trim(g) AS gene FROM (
  SELECT unnest(string_split(f, '_')) AS g FROM (
    SELECT unnest([p[3], p[4]]) AS f FROM (SELECT string_split(lri_name, '|') AS p FROM rawnames) WHERE len(p) >= 4))
WHERE trim(g) <> ''""")
def _(t: Inputs):
    return names.extract_lri_genes(raw_names(t))


@query("fn_safe_name", r"""
SELECT o_orderkey, trim(regexp_replace(label, '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS safe
FROM (SELECT o_orderkey, '/ ' || o_orderpriority || ' (' || o_orderstatus || ')' AS label FROM orders)""")
def _(t: Inputs):
    label = F.concat(F.lit("/ "), "o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(")"))
    return t.table("orders").select("o_orderkey", names.safe_name(label).alias("safe"))


@query("fn_motif_label", """
SELECT o_orderkey, motif, CASE motif WHEN 0 THEN 'Immune hub' WHEN 2 THEN 'Edge/tip' ELSE 'Motif ' || motif END || '_celltype_' || o_orderstatus AS raw_title,
  replace(CASE motif WHEN 0 THEN 'Immune hub' WHEN 2 THEN 'Edge/tip' ELSE 'Motif ' || motif END || '_celltype_' || o_orderstatus, '_', ' ') AS title,
  CASE motif WHEN 0 THEN 'Immune_hub' WHEN 2 THEN 'Edge_tip' ELSE CAST(motif AS STRING) END || '_celltype_' || o_orderstatus AS key_slug
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 4 AS INT) AS motif FROM orders)""")
def _(t: Inputs):
    given = t.spark.createDataFrame([(0, "Immune hub"), (2, "Edge/tip")], "motif int, name string")
    rows = t.table("orders").select("o_orderkey", "o_orderstatus", F.expr("CAST(o_orderkey % 4 AS INT)").alias("motif"))
    named = names.motif_labels(rows, given)
    key = F.concat(F.lit("motif_"), F.col("motif").cast("string"), F.lit("_celltype_"), F.col("o_orderstatus"))
    return named.select(
        "o_orderkey", "motif", F.concat("label", F.lit("_celltype_"), "o_orderstatus").alias("raw_title"),
        names.relabel_motif_key(key, F.col("label"), F.col("slug")).alias("k"),
    ).select("o_orderkey", "motif", "raw_title", "k.*")


@query("fn_binarize", "SELECT DISTINCT sample_id, cell_id, gene FROM expression WHERE count > 20")
def _(t: Inputs):
    shifted = t.expression().withColumn("count", F.col("count") - 20)
    return shifted.where(F.col("count") > 0).select("sample_id", "cell_id", "gene").distinct()


base.CTE["cov"] = """
  SELECT l.sample_id, l.cell_id, c.cell_type, motif, loading,
         (ln(loading) - avg(ln(loading)) OVER w) / (CASE WHEN stddev_pop(ln(loading)) OVER w > 0 THEN stddev_pop(ln(loading)) OVER w ELSE 1 END) AS x
  FROM loadings l JOIN cells c ON l.sample_id = c.sample_id AND l.cell_id = c.cell_id
  WHERE c.cell_type IS NOT NULL AND loading > 0 WINDOW w AS (PARTITION BY motif, c.cell_type)"""


@query("fn_log_zscore", "SELECT sample_id, cell_id, cell_type, motif, round(x, 6) AS x FROM cov")
def _(t: Inputs):
    return stats.covariates(t.loadings(), t.cells()).select("sample_id", "cell_id", "cell_type", "motif", r6("x", "x"))


@query("fn_neg_log10_q", "SELECT motif, cell_type, gene, round(-log10(greatest(qval, 1e-300)), 6) AS y, qval <= 1e-300 AS capped FROM de WHERE qval IS NOT NULL")
def _(t: Inputs):
    d = de.complete_results(de_rows(t))
    return d.select("motif", "cell_type", "gene", r6(names.neg_log10_q(F.col("qval")), "y"), (F.col("qval") <= 1e-300).alias("capped"))


base.CTE["lm"] = """
  SELECT f.lri_idx, f.motif, i.lri_name, f.factor, m.total / (SELECT count(*) FROM patchtable) AS mean,
         i.celltype1, i.celltype2, i.ligand, i.receptor, i.mode AS signaling_type
  FROM factors f JOIN lri i USING (lri_idx)
  JOIN (SELECT lr_id, celltype1, celltype2, mode, sum(value) AS total FROM pmatrix GROUP BY ALL) m USING (lr_id, celltype1, celltype2, mode)"""


def motif_table(t: Inputs):
    matrix, columns = t.matrix(), t.lri()
    n_regions = occupied(t)
    means = motifs.column_means(interactions.indexed_matrix(matrix, columns), n_regions)
    ks = F.explode(F.array(*[F.lit(k) for k in range(base.K)])).alias("k")
    factors = columns.select("lri_idx", ks).select("lri_idx", F.col("k").alias("motif"), F.expr(base.FACTOR).alias("factor"))
    return motifs.lri_motifs(factors, columns, means)


def occupied(t: Inputs):
    placed = regions.assign_patches(t.cells()).where("patch_id IS NOT NULL").select("sample_id", "patch_id")
    return placed.distinct().agg(F.count("*").alias("n_regions"))


ROUNDED = "lri_idx, motif, lri_name, round(factor, 6) AS factor, round(mean, 6) AS mean, celltype1, celltype2, ligand, receptor, signaling_type"


def rounded(df):
    return df.select(*[r6(c, c) if c in ("factor", "mean") else F.col(c) for c in df.columns])


@query("flt_exclude_ct", f"SELECT {ROUNDED} FROM lm WHERE NOT (regexp_matches(celltype1, 'ur|low$', 'i') OR regexp_matches(celltype2, 'ur|low$', 'i'))")
def _(t: Inputs):
    return rounded(motifs.exclude_celltypes(motif_table(t), ["UR", "low$"]))


@query("flt_sender_receiver", f"SELECT {ROUNDED} FROM lm WHERE motif = 1 AND celltype1 = '1-URGENT' AND celltype2 = '2-HIGH'")
def _(t: Inputs):
    return rounded(motifs.only_motif(motif_table(t), 1, "1-URGENT", "2-HIGH"))


@query("flt_mode", f"SELECT {ROUNDED} FROM lm WHERE signaling_type = 'juxtacrine'")
def _(t: Inputs):
    return rounded(motifs.only_mode(motif_table(t), " J"))


@query("flt_motif_ids", "SELECT * FROM loadings WHERE motif IN (1, 3)")
def _(t: Inputs):
    return motifs.only_motifs(t.loadings(), [1, 3])


@query("flt_mean_positive", f"SELECT {ROUNDED} FROM lm WHERE mean > 0")
def _(t: Inputs):
    return rounded(motif_table(t))


@query("flt_incomplete_de", """
SELECT count(*) FILTER (n = 0) AS n_dropped, count(*) FILTER (n > 0) AS n_kept
FROM (SELECT motif, cell_type, count(CASE WHEN gene >= 'G03' THEN qval END) AS n FROM de GROUP BY ALL)""")
def _(t: Inputs):
    return de.dropped_results(de_rows(t).withColumn("qval", F.when(F.col("gene") >= "G03", F.col("qval"))))


@query("flt_skip_ct", "SELECT sample_id, cell_id, cell_type, motif, round(x, 6) AS x FROM cov WHERE cell_type NOT IN ('5-LOW', '2-HIGH')")
def _(t: Inputs):
    return stats.covariates(t.loadings(), t.cells(), ["5-LOW", "2-HIGH"]).select("sample_id", "cell_id", "cell_type", "motif", r6("x", "x"))


@query("flt_required_cols", """
SELECT n.sample_id, n.region_id, lri.lri_idx, n.value FROM nmatrix n JOIN lri USING (lr_id, celltype1, celltype2, mode)""")
def _(t: Inputs):
    pairs = t.pairs()
    near = interactions.cell_lri(t.cells(), t.expression(), pairs)
    types = readers.typed_cells(t.cells()).select("cell_type").distinct()
    return interactions.align_columns(near, lrdb.lri_space(pairs, types), t.lri())


@query("chk_align", """
SELECT (SELECT count(*) FROM (SELECT lri_name FROM lri GROUP BY ALL HAVING count(*) > 1)) AS model_repeats,
       (SELECT count(*) FROM (SELECT lri_name FROM rawnames GROUP BY ALL HAVING count(*) > 1)) AS cell_repeats,
       (SELECT count(*) FROM lri WHERE lri_name NOT IN (SELECT lri_name FROM rawnames)) AS missing""")
def _(t: Inputs):
    return interactions.alignment_problems(t.lri(), raw_names(t))
