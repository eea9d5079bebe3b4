"""Differential expression along motif loadings: Poisson regression and report tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import names
from cellweave.functions.special import wald_p_values
from cellweave.operators import stats
from cellweave.session import cut_lineage, require, small_table

# The covariate's distribution in a group is stored as moments in bins of this width. With
# ORDER moments per bin, sums of exp(b x) are exact to rounding for |b| well beyond any
# estimate (remainder below (|b| BIN_WIDTH/2)^ORDER / ORDER!). Slopes beyond MAX_SLOPE are not
# estimated: such genes have converged = false and no estimate.
BIN_WIDTH = 1.0 / 32
ORDER = 14
MAX_SLOPE = 60.0
GENE_TILE = 2048


def candidate_genes(genes: DataFrame, lri_names: DataFrame) -> DataFrame:
    """Panel genes that no interaction name mentions."""
    return genes.select("gene").distinct().join(names.extract_lri_genes(lri_names), "gene", "left_anti")


def covariate_bins(cov: DataFrame) -> DataFrame:
    """Per (motif, cell type, bin): power sums of x around the bin centre, and x extremes.

    The number of bins depends on the range of x only, so any number of cells in a group
    becomes a table of a few hundred rows.
    """
    b = F.floor(F.col("x") / BIN_WIDTH)
    d = F.col("x") - (F.col("bin") + 0.5) * BIN_WIDTH
    powers, p = [], F.lit(1.0)
    for i in range(ORDER):
        powers.append(F.sum(p).alias(f"m{i}"))
        p = p * d
    return cov.withColumn("bin", b).groupBy("motif", "cell_type", "bin").agg(
        *powers, F.min("x").alias("x_lo"), F.max("x").alias("x_hi")
    )


def gene_sums(cov: DataFrame, expression: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Per (motif, cell type, gene): sum of y and of x y over nonzero counts."""
    hits = expression.where(F.col("count") > 0)
    entries = hits.join(stats.per_cell(cov, "x").hint("merge"), ["sample_id", "cell_id"]).select(
        "cell_type", "gene", "count", F.inline("entries")
    )
    sums = entries.groupBy("motif", "cell_type", "gene").agg(
        F.sum("count").alias("sy"), F.sum(F.col("count") * F.col("x")).alias("sxy")
    )
    return sums if keep is None else sums.join(keep, ["motif", "cell_type", "gene"], "left_semi")


def _exp_sums(b: np.ndarray, centers: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, ...]:
    """log-scale and sums of exp(bx), x exp(bx), x^2 exp(bx) for every slope in ``b``."""
    fact = np.array([math.factorial(i) for i in range(ORDER - 2)], dtype=float)
    powers = b[:, None] ** np.arange(ORDER - 2) / fact
    e0, e1, e2 = (powers @ moments[:, s : s + ORDER - 2].T for s in range(3))
    z = b[:, None] * centers[None, :]
    top = z.max(axis=1, keepdims=True)
    w = np.exp(z - top)
    s0 = (w * e0).sum(1)
    s1 = (w * (centers * e0 + e1)).sum(1)
    s2 = (w * (centers**2 * e0 + 2 * centers * e1 + e2)).sum(1)
    return top[:, 0], s0, s1, s2


def _solve_slopes(ratio: np.ndarray, centers: np.ndarray, moments: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of mean_b(x) = ratio per gene: Newton steps kept inside a bisection bracket.

    A root outside the bracket, where the moments are no longer exact, counts as not found.
    """
    lo, hi = np.full_like(ratio, -MAX_SLOPE), np.full_like(ratio, MAX_SLOPE)
    ends = []
    for b in (lo, hi):
        _, s0, s1, _ = _exp_sums(b[:1], centers, moments)
        ends.append(float(s1[0] / s0[0]))
    inside = (ratio >= ends[0]) & (ratio <= ends[1])
    b = np.zeros_like(ratio)
    done = np.zeros(ratio.shape, dtype=bool)
    for _ in range(max_iter):
        _, s0, s1, s2 = _exp_sums(b, centers, moments)
        mean = s1 / s0
        gap = mean - ratio
        hi, lo = np.where(gap > 0, b, hi), np.where(gap <= 0, b, lo)
        var = np.maximum(s2 / s0 - mean * mean, 1e-300)
        step = b - gap / var
        nxt = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        moved = np.abs(nxt - b)
        b = np.where(done, b, nxt)
        done |= moved <= 1e-13 * np.maximum(1.0, np.abs(b))
        if done.all():
            break
    return b, done & inside


def _fit_tile(genes: pd.DataFrame, bins: pd.DataFrame, max_iter: int) -> pd.DataFrame:
    centers = (bins["bin"].to_numpy(float) + 0.5) * BIN_WIDTH
    moments = bins[[f"m{i}" for i in range(ORDER)]].to_numpy(float)
    sy, sxy = genes["sy"].to_numpy(float), genes["sxy"].to_numpy(float)
    ratio = sxy / sy
    x_lo, x_hi = bins["x_lo"].min(), bins["x_hi"].max()
    margin = 1e-12 * max(1.0, abs(x_lo), abs(x_hi))
    exists = (ratio > x_lo + margin) & (ratio < x_hi - margin)
    b1 = np.full_like(ratio, np.nan)
    converged = np.zeros(ratio.shape, dtype=bool)
    if exists.any():
        b1[exists], converged[exists] = _solve_slopes(ratio[exists], centers, moments, max_iter)
    b1 = np.where(converged, b1, np.nan)
    top, s0, _, s2 = _exp_sums(np.nan_to_num(b1), centers, moments)
    se = 1 / np.sqrt(sy * s2 / s0)
    out = genes[["motif", "cell_type", "gene"]].copy()
    out["intercept"] = np.where(converged, np.log(sy) - np.log(s0) - top, np.nan)
    out["logfc"] = b1
    out["se"] = np.where(converged, se, np.nan)
    out["pval"] = np.where(converged, wald_p_values(np.nan_to_num(b1 / se)), np.nan)
    out["converged"] = converged
    return out


FIT_SCHEMA = (
    "motif int, cell_type string, gene string, intercept double, logfc double, se double, pval double, converged boolean"
)


def poisson_glm(cov: DataFrame, expression: DataFrame, keep: DataFrame | None = None, max_iter: int = 100, tile: int = GENE_TILE) -> DataFrame:
    """Slope of log expression on the covariate for every (motif, cell type, gene).

    The likelihood needs a gene only through its two sums, and the covariate only through
    sums of exp(b x), which the binned moments give. Expression is read once; the solver
    sees one tile of genes and one group's bins at a time, never cells.
    ``logfc`` is the natural-log slope per standard deviation of log loading.
    """
    sums = gene_sums(cov, expression, keep)
    n_tiles = F.ceil(F.count("*").over(Window.partitionBy("motif", "cell_type")) / tile)
    order = F.row_number().over(Window.partitionBy("motif", "cell_type").orderBy("gene"))
    genes = sums.withColumn("tiles", n_tiles).withColumn("tile", order % F.col("tiles"))
    tiles = small_table(genes.groupBy("motif", "cell_type").agg(F.max("tiles").alias("tiles")))
    bins = covariate_bins(cov).join(tiles, ["motif", "cell_type"]).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    )
    key = ["motif", "cell_type", "tile"]

    def fit(g: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if g.empty or b.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
        return _fit_tile(g, b, max_iter)

    # Both sides stem from the covariates; renaming gives the bins columns of their own.
    bins = bins.toDF(*bins.columns)
    fitted = genes.withColumn("tile", F.col("tile").cast("long")).groupBy(*key).cogroup(bins.groupBy(*key)).applyInPandas(fit, FIT_SCHEMA)
    clean = lambda c: F.when(F.col("converged"), F.col(c)).alias(c)
    return fitted.select("motif", "cell_type", "gene", clean("intercept"), clean("logfc"), clean("se"), clean("pval"), "converged")


def adjust(fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values per (motif, cell type); genes without an estimate stay, untested."""
    tested = stats.benjamini_hochberg(fits, ["motif", "cell_type"]).withColumn("significant", F.col("qval") <= alpha)
    rest = fits.where(F.col("pval").isNull()).withColumn("qval", F.lit(None).cast("double")).withColumn("significant", F.lit(False))
    return tested.unionByName(rest)


def run_de(
    loadings: DataFrame, cells: DataFrame, expression: DataFrame, genes: DataFrame, lri_names: DataFrame,
    alpha: float = 0.05, spearman_threshold: float | None = 0.001, skip_cell_types: tuple[str, ...] = ("granulocyte",),
) -> DataFrame:
    """Candidate genes, covariates, rank-correlation prefilter, regression, adjustment."""
    cov = stats.covariates(loadings, cells, list(skip_cell_types))
    candidates = small_table(candidate_genes(genes, lri_names))
    counted = expression.join(candidates, "gene", "left_semi")
    keep = None
    if spearman_threshold is not None:
        keep = stats.spearman_prefilter(stats.spearman(cov, counted), spearman_threshold)
    return adjust(poisson_glm(cov, counted, keep), alpha)


def complete_results(de: DataFrame) -> DataFrame:
    """Rows with an adjusted p-value."""
    return de.where(F.col("qval").isNotNull())


def dropped_results(de: DataFrame) -> DataFrame:
    """Number of (motif, cell type) results in which no gene has an adjusted p-value."""
    per = de.groupBy("motif", "cell_type").agg(F.count("qval").alias("n"))
    return per.agg(F.count_if(F.col("n") == 0).alias("n_dropped"), F.count_if(F.col("n") > 0).alias("n_kept"))


def filter_expressed(de: DataFrame, fractions: DataFrame, min_fraction: float = 0.02) -> DataFrame:
    """Keep genes that enough cells of the type express."""
    enough = fractions.where(F.col("fraction") >= min_fraction).select("cell_type", "gene")
    return de.join(enough, ["cell_type", "gene"], "left_semi")


def drop_foreign_markers(de: DataFrame, markers: DataFrame) -> DataFrame:
    """Drop genes that mark any other cell type; a type's own markers stay."""
    m = small_table(markers.select(F.col("cell_type").alias("marks"), F.col("gene").alias("marker")))
    return de.join(m, (F.col("gene") == F.col("marker")) & (F.col("cell_type") != F.col("marks")), "left_anti")


def volcano(de: DataFrame, fdr: float = 0.05, lfc: float = 0.2, n_top: int = 30) -> DataFrame:
    """Class of every gene and the genes to label, per (motif, cell type)."""
    group = Window.partitionBy("motif", "cell_type")
    y = names.neg_log10_q(F.col("qval"))
    scaled = (
        complete_results(de).withColumn("neg_log10_q", y).withColumn("capped", F.col("qval") <= 1e-300)
        .withColumn("_mx", F.max(F.abs("logfc")).over(group)).withColumn("_my", F.max("neg_log10_q").over(group))
    )
    usable = (F.col("_mx") > 0) & (F.col("_my") > 0)
    height = F.col("neg_log10_q") / F.col("_my")
    side = F.when(F.col("logfc") >= lfc, 1).when(F.col("logfc") <= -lfc, -1).otherwise(0)
    sig = F.col("neg_log10_q") >= -math.log10(fdr)
    classed = scaled.withColumn(
        "class",
        F.when((side == 1) & sig, "up").when((side == -1) & sig, "down")
        .when(side == 1, "right_ns").when(side == -1, "left_ns").otherwise("middle"),
    ).withColumn(
        "score", F.when(usable, F.abs("logfc") / F.col("_mx") + height).otherwise(F.lit(0.0))
    )
    rank = F.row_number().over(Window.partitionBy("motif", "cell_type", "class").orderBy(F.desc("score"), "gene"))
    return classed.withColumn("labeled", F.col("class").isin("up", "down") & (rank <= n_top)).select(
        "motif", "cell_type", "gene", "logfc", "qval", "neg_log10_q", "capped", "class", "score", "labeled"
    )


def forest(de: DataFrame, n_top: int = 20, max_lfc: float | None = 10.0) -> DataFrame:
    """Strongest genes per (motif, cell type) with 95% Wald intervals, by effect.

    Effects beyond ``max_lfc`` have no place on the figure's axis; None keeps them.
    """
    group = Window.partitionBy("motif", "cell_type")
    shown = complete_results(de) if max_lfc is None else complete_results(de).where(F.abs("logfc") <= max_lfc)
    scored = shown.withColumn(
        "score", F.abs("logfc") * names.neg_log10_q(F.col("qval"))
    )
    top = scored.withColumn("_r", F.row_number().over(group.orderBy(F.desc("score"), "gene"))).where(F.col("_r") <= n_top)
    return top.select(
        "motif", "cell_type", "gene", "logfc", "se", "qval", "score",
        (F.col("logfc") - 1.96 * F.col("se")).alias("ci_low"), (F.col("logfc") + 1.96 * F.col("se")).alias("ci_high"),
        F.row_number().over(group.orderBy("logfc", "gene")).alias("position"),
    )


def report(de: DataFrame, cells: DataFrame, expression: DataFrame, markers: DataFrame | None = None,
           min_fraction: float = 0.02, marker_lfc: float = 1.0, marker_p: float = 1e-5,
           subsample: int | None = None, fdr: float = 0.05, lfc: float = 0.2, n_volcano: int = 30, n_forest: int = 30,
           genes: DataFrame | None = None, max_lfc: float | None = 10.0) -> dict[str, DataFrame]:
    """Filtered results and their volcano and forest tables.

    Markers are searched over all cells; ``subsample`` draws at most so many for either side.
    """
    if markers is None:
        markers = stats.marker_genes(
            stats.differential_expression(cells, expression, subsample=subsample, genes=genes), marker_lfc, marker_p
        )
    # Both are read by several tables; they take whole passes over the counts to make.
    markers = cut_lineage(markers)
    kept = cut_lineage(drop_foreign_markers(
        filter_expressed(complete_results(de), stats.expression_fraction(cells, expression), min_fraction), markers
    ))
    return {"filtered": kept, "volcano": volcano(kept, fdr, lfc, n_volcano), "forest": forest(kept, n_forest, max_lfc), "markers": markers}


def require_same_cells(loadings: DataFrame, cells: DataFrame) -> None:
    """Every loading row must belong to a known cell."""
    stray = loadings.join(cells, ["sample_id", "cell_id"], "left_anti")
    require(stray.limit(1).isEmpty(), "loadings name cells that are not in the cell table")
