"""Rank statistics and multiple testing on sparse counts.

Genes are summarized as histograms of their nonzero counts; all cells without a count form
one block of zeros that is handled in closed form. Nothing here is the size of cells x genes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.special import normal_tail, t_tail
from cellweave.operators import ranks
from cellweave.operators.ranks import sample_group
from cellweave.session import small_table, with_each


def covariates(loadings: DataFrame, cells: DataFrame, skip_cell_types: list[str] | None = None) -> DataFrame:
    """(sample_id, cell_id, cell_type, motif, loading, x): log loading, z-scored per (motif, type).

    Means and deviations are aggregated to one row per group and joined back, so a cell
    type with a third of all cells is never one window.
    """
    typed = cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type")
    if skip_cell_types:
        typed = typed.where(~F.col("cell_type").isin(skip_cell_types))
    usable = loadings.where((F.col("loading") > 0) & ~F.isnan("loading"))
    logs = usable.join(typed, ["sample_id", "cell_id"]).withColumn("lx", F.log("loading"))
    moments = small_table(logs.groupBy("motif", "cell_type").agg(
        F.avg("lx").alias("mu"), F.stddev_pop("lx").alias("sd")
    ))
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return logs.join(moments, ["motif", "cell_type"]).select(
        "sample_id", "cell_id", "cell_type", "motif", "loading", ((F.col("lx") - F.col("mu")) / scale).alias("x")
    )


def per_cell(cov: DataFrame, *fields: str) -> DataFrame:
    """One row per cell with its (at most K) motif entries, for one join to expression."""
    return cov.groupBy("sample_id", "cell_id").agg(
        F.first("cell_type").alias("cell_type"), F.collect_list(F.struct("motif", *fields)).alias("entries")
    )


def spearman(cov: DataFrame, expression: DataFrame) -> DataFrame:
    """(motif, cell_type, gene, n, rho, t, pval) of the covariate against every gene.

    Genes without a count in the group are left out (their correlation is 0).
    """
    group = ["motif", "cell_type"]
    x_ranks = ranks.average_ranks(cov, group, "x")
    totals = small_table(x_ranks.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("sxx")
    ))
    ranked = cov.join(x_ranks.select(*group, "x", F.col("rank").alias("rx")), [*group, "x"])
    hits = expression.where(F.col("count") > 0).join(per_cell(ranked, "rx").hint("merge"), ["sample_id", "cell_id"])
    values = hits.select("cell_type", "gene", "count", F.inline("entries")).groupBy(*group, "gene", "count").agg(
        F.count("*").alias("nv"), F.sum("rx").alias("srx")
    )
    # One row per distinct count value of a gene: a window over few rows.
    gene = Window.partitionBy(*group, "gene")
    below = gene.orderBy("count")
    ry = F.col("n0") + F.sum("nv").over(below) - F.col("nv") + (F.col("nv") + 1) / 2
    ranked_values = (
        values.join(totals, group)
        .withColumn("n0", F.col("n") - F.sum("nv").over(gene))
        .withColumn("ry", ry)
    )
    m = (F.col("n") + 1) / 2
    r0 = (F.col("n0") + 1) / 2
    sums = ranked_values.groupBy(*group, "gene", "n", "n0", "sxx").agg(
        F.sum(F.col("ry") * F.col("srx")).alias("sxy"), F.sum("srx").alias("sx"),
        F.sum(F.col("nv") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    cross = F.col("sxy") + r0 * (F.col("n") * m - F.col("sx")) - F.col("n") * m * m
    var_x = F.col("sxx") - F.col("n") * m * m
    var_y = F.col("syy") + F.col("n0") * r0 * r0 - F.col("n") * m * m
    rho = F.when(var_y <= 0, F.lit(0.0)).otherwise(F.try_divide(cross, F.sqrt(var_x) * F.sqrt(var_y)))
    out = sums.select(*group, "gene", "n", rho.alias("rho")).withColumn(
        "t", F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho") + 1e-10))
    )
    return out.withColumn("pval", t_tail(F.col("t"), F.col("n") - 2))


def spearman_prefilter(tested: DataFrame, threshold: float = 0.001) -> DataFrame:
    """(motif, cell_type, gene) with an uncorrected p-value below the threshold."""
    return tested.where(F.col("pval") < threshold).select("motif", "cell_type", "gene")


def benjamini_hochberg(df: DataFrame, group: list[str], p: str = "pval", q: str = "qval") -> DataFrame:
    """Add the adjusted p-value. A group holds one row per gene, never per cell."""
    by_p = Window.partitionBy(*group).orderBy(p)
    rank = F.row_number().over(by_p)
    count = F.count(p).over(Window.partitionBy(*group))
    from_largest = Window.partitionBy(*group).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    raw = df.where(F.col(p).isNotNull()).withColumn("_rank", rank).withColumn("_raw", F.col(p) * count / F.col("_rank"))
    return raw.withColumn(q, F.least(F.lit(1.0), F.min("_raw").over(from_largest))).drop("_rank", "_raw")


def _zero_aware_ranks(hist: DataFrame, key: list[str]) -> DataFrame:
    """Per (key, gene, count): rank among all cells; per gene the zero block and tie term.

    ``hist`` has (key, gene, count, nv, n) with nv cells at that count out of n.
    """
    gene = Window.partitionBy(*key, "gene")
    cube = lambda c: F.col(c).cast("double") * F.col(c) * F.col(c) - F.col(c)
    return (
        hist.withColumn("n0", F.col("n") - F.sum("nv").over(gene))
        .withColumn("rank", F.col("n0") + F.sum("nv").over(gene.orderBy("count")) - F.col("nv") + (F.col("nv") + 1) / 2)
        .withColumn("ties", F.sum(cube("nv")).over(gene) + cube("n0"))
        .withColumn("tied", (F.max("nv").over(gene) > 1) | (F.col("n0") > 1))
    )


def _exact_mwu(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact two-sided p-value of U without ties, by counting arrangements.

    The upper tail from U equals the lower one up to n1 n2 - U. One table for each pair of sizes
    serves all rows, and it reaches only as far as the longest of those tails.
    """
    out = np.full(len(u), np.nan)
    known = np.flatnonzero(u.notna() & n1.notna() & n2.notna())
    if not len(known):
        return pd.Series(out)
    sizes = np.sort(np.stack([n1.to_numpy(float)[known], n2.to_numpy(float)[known]], axis=1).astype(np.int64), axis=1)
    tail = sizes[:, 0] * sizes[:, 1] - np.ceil(u.to_numpy(float)[known]).astype(np.int64)
    for a, b in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (a, b)).all(1))
        most = int(tail[rows].max())
        # Partitions into at most a parts of at most b each: the product over k of
        # (1 - x^(b + k)) / (1 - x^k), factor by factor.
        ways = np.zeros(most + 1)
        ways[:1] = 1.0
        for k in range(1, a + 1):
            if b + k <= most:
                ways[b + k:] = ways[b + k:] - ways[:most + 1 - b - k]
            for start in range(min(k, most + 1)):
                ways[start::k] = np.cumsum(ways[start::k])
        share = np.cumsum(ways) / math.comb(a + b, a)
        out[known[rows]] = np.minimum(1.0, 2 * np.where(tail[rows] >= 0, share[np.maximum(tail[rows], 0)], 0.0))
    return pd.Series(out)


def mann_whitney(rank_sums: DataFrame, r1: str, n1: str, n2: str, ties: str, tied: str) -> DataFrame:
    """Add u1, z and two-sided p-value to rows holding a rank sum and group sizes.

    Exact distribution if one group has at most 8 members and nothing is tied, else the
    normal approximation with tie and continuity correction.
    """
    a, b = F.col(n1).cast("double"), F.col(n2).cast("double")
    n = a + b
    u1 = F.col(r1) - a * (a + 1) / 2
    larger = F.greatest(u1, a * b - u1)
    sigma = F.sqrt(a * b / 12 * ((n + 1) - F.col(ties) / (n * (n - 1))))
    z = F.when(sigma > 0, (larger - a * b / 2 - 0.5) / sigma)
    small = (F.least(a, b) <= 8) & ~F.col(tied)
    exact = F.pandas_udf(_exact_mwu, "double")
    scored = rank_sums.withColumn("u1", u1).withColumn("z", z).withColumn("_u", F.when(small, larger))
    # |z| is never below 0 here except through the continuity correction, where p is 1.
    approx = F.when(sigma.isNull() | (sigma <= 0), F.lit(1.0)).when(F.col("z") <= 0, F.lit(1.0)).otherwise(normal_tail(F.col("z")))
    return scored.withColumn("pval", approx).withColumn(
        "pval", F.when(F.col("_u").isNull(), F.col("pval")).otherwise(exact("_u", F.when(small, a), F.when(small, b)))
    ).drop("_u")


def value_histogram(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """(cell_type, gene, count, n): cells of a type at each nonzero count of a gene."""
    typed = cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type")
    hits = expression.where(F.col("count") > 0).select("sample_id", "cell_id", "gene", "count")
    return hits.join(typed.hint("merge"), ["sample_id", "cell_id"]).groupBy("cell_type", "gene", "count").agg(F.count("*").alias("nt"))


def differential_expression(
    cells: DataFrame, expression: DataFrame, min_fraction: float = 1e-4,
    target_filter: str = "global", subsample: int | None = None, seed: int = 0, genes: DataFrame | None = None,
) -> DataFrame:
    """Each cell type against the rest: log2 fold change, Mann-Whitney p, adjusted p.

    ``genes`` is the panel (a ``gene`` column): the share of expressed genes that the "global"
    target filter looks at is of all panel genes, and genes that no cell has a count for are
    returned with p = 1 and no change. Without it the genes with a count are taken as the panel.

    Without subsampling one histogram per (type, gene, count) serves all comparisons, and
    gene ranks are computed once. With it, every type draws at most ``subsample`` cells
    for either side and gets its own histogram.
    """
    typed = cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type")
    if subsample is None:
        hist = value_histogram(cells, expression)
        sizes = typed.groupBy("cell_type").agg(F.count("*").alias("n1"))
        sizes = small_table(sizes.withColumn("n", F.sum("n1").over(Window.partitionBy())))
        everyone = small_table(sizes.agg(F.max("n").alias("n")))
        values = hist.groupBy("gene", "count").agg(F.sum("nt").alias("nv"))
        ranked = _zero_aware_ranks(with_each(values, everyone), [])
        inside = hist.select(F.col("cell_type"), "gene", "count", F.col("nt").alias("n_in"))
        keyed = ranked
    else:
        drawn = drawn_cells(typed, subsample, seed)
        sizes = small_table(drawn.groupBy("target").agg(
            F.count_if("is_in").alias("n1"), F.count("*").alias("n")
        ).withColumnRenamed("target", "cell_type"))
        hits = expression.where(F.col("count") > 0).select("sample_id", "cell_id", "gene", "count")
        hist = hits.join(drawn.hint("merge"), ["sample_id", "cell_id"]).groupBy(
            F.col("target").alias("cell_type"), "gene", "count"
        ).agg(F.count("*").alias("nv"), F.count_if("is_in").alias("n_in"))
        keyed = _zero_aware_ranks(hist.join(sizes.select("cell_type", "n"), "cell_type"), ["cell_type"])
        inside = hist.select("cell_type", "gene", "count", "n_in")
    key = ["cell_type", "gene"] if subsample is not None else ["gene"]
    overall = keyed.groupBy(*key, "n0", "ties", "tied").agg(
        F.sum("nv").alias("nz"), F.sum(F.col("nv") * F.col("count")).alias("total")
    )
    mine = inside.join(keyed.select(*key, "count", "rank"), [*key, "count"]).groupBy("cell_type", "gene").agg(
        F.sum("n_in").alias("nz_in"), F.sum(F.col("n_in") * F.col("count")).alias("total_in"),
        F.sum(F.col("n_in") * F.col("rank")).alias("rank_sum"),
    )
    pairs = overall.join(sizes, "cell_type") if subsample is not None else with_each(overall, sizes)
    full = pairs.join(mine, ["cell_type", "gene"], "left").na.fill(0, ["nz_in", "total_in", "rank_sum"])
    r0 = (F.col("n0") + 1) / 2
    n2 = F.col("n") - F.col("n1")
    panel = None if genes is None else genes.select("gene").where(F.col("gene").isNotNull()).distinct()
    panel_size = F.count("*").over(Window.partitionBy("cell_type")) if panel is None else F.lit(max(panel.count(), 1))
    full = (
        full.withColumn("n2", n2)
        .withColumn("r1", F.col("rank_sum") + r0 * (F.col("n1") - F.col("nz_in")))
        .withColumn("frac_in", F.col("nz_in") / F.col("n1"))
        .withColumn("frac_out", (F.col("nz") - F.col("nz_in")) / F.col("n2"))
        .withColumn("_mean_frac", F.sum("nz_in").over(Window.partitionBy("cell_type")) / (F.col("n1") * panel_size))
    )
    target_ok = (F.col("_mean_frac") if target_filter == "global" else F.col("frac_in")) >= min_fraction
    mean = lambda total, n: F.log2(F.greatest(total / n, F.lit(1e-300)))
    kept = full.withColumn("tested", (F.col("frac_out") >= min_fraction) & target_ok)
    scored = mann_whitney(kept.where("tested"), "r1", "n1", "n2", "ties", "tied").withColumn(
        "log2fc", mean(F.col("total_in"), F.col("n1")) - mean(F.col("total") - F.col("total_in"), F.col("n2"))
    )
    scored = benjamini_hochberg(scored, ["cell_type"], "pval", "padj")
    rest = kept.where("NOT tested").select(
        "cell_type", "gene", F.lit(None).cast("double").alias("u1"), F.lit(0.0).alias("log2fc"),
        F.lit(1.0).alias("pval"), F.lit(1.0).alias("padj"), "tested",
    )
    if panel is not None:
        unseen = with_each(panel.join(values_of(expression), "gene", "left_anti"), sizes.select("cell_type"))
        rest = rest.unionByName(unseen.select(
            "cell_type", "gene", F.lit(None).cast("double").alias("u1"), F.lit(0.0).alias("log2fc"),
            F.lit(1.0).alias("pval"), F.lit(1.0).alias("padj"), F.lit(False).alias("tested"),
        ))
    return scored.select("cell_type", "gene", "u1", "log2fc", "pval", "padj", "tested").unionByName(rest)


def values_of(expression: DataFrame) -> DataFrame:
    """Genes with any count."""
    return expression.where(F.col("count") > 0).select("gene").distinct()


def drawn_cells(typed: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(sample_id, cell_id, target, is_in): for every type, up to ``n`` cells of it and up
    to ``n`` others."""
    types = small_table(typed.select(F.col("cell_type").alias("target")).distinct())
    roles = with_each(typed, types).withColumn("is_in", F.col("cell_type") == F.col("target"))
    return sample_group(roles, ["target", "is_in"], n, ["sample_id", "cell_id"], seed).drop("cell_type")


def marker_genes(de: DataFrame, lfc: float = 1.0, p: float = 1e-5) -> DataFrame:
    """(cell_type, gene) of genes raised in a type against the rest."""
    return de.where((F.col("padj") <= p) & (F.col("log2fc") >= lfc)).select("cell_type", "gene")


def marker_summary(markers: DataFrame, cell_types: DataFrame, genes: DataFrame) -> DataFrame:
    """Markers per type: number and share of the panel; types without markers included."""
    panel = small_table(genes.agg(F.countDistinct("gene").alias("n_genes")))
    found = markers.groupBy("cell_type").agg(F.count("*").alias("n_marker_genes"))
    per_type = cell_types.select("cell_type").join(found, "cell_type", "left").na.fill(0, ["n_marker_genes"])
    return with_each(per_type, panel).select(
        "cell_type", "n_marker_genes", (F.col("n_marker_genes") / F.col("n_genes") * 100).alias("marker_percentage")
    )


def expression_fraction(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Share of a type's cells with a count for a gene."""
    typed = cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type")
    sizes = small_table(typed.groupBy("cell_type").agg(F.count("*").alias("n_cells")))
    hits = expression.where(F.col("count") > 0).select("sample_id", "cell_id", "gene")
    return (
        hits.join(typed.hint("merge"), ["sample_id", "cell_id"]).groupBy("cell_type", "gene").agg(F.count("*").alias("n_expr"))
        .join(sizes, "cell_type").select("cell_type", "gene", "n_expr", (F.col("n_expr") / F.col("n_cells")).alias("fraction"))
    )
