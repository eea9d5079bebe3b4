"""Motif states per cell (mixture model) and their summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import stats

EPS = 1e-10
REG_COVAR = 1e-6
# Bins for each unit of a log loading.
BINS = 512
PARAMS = "motif int, shift double, w0 double, mu0 double, var0 double, w1 double, mu1 double, var1 double"


def _log_scores(loadings: DataFrame) -> DataFrame:
    return loadings.withColumn("s", F.log(F.col("loading") + F.lit(EPS)))


def _maximize(scored: DataFrame) -> DataFrame:
    """One pass: both components' sums for all motifs at once (``r`` is P(high))."""
    c = F.col("s") - F.col("shift")
    r1, r0 = F.col("r"), 1 - F.col("r")
    return scored.groupBy("motif", "shift").agg(
        F.count("*").alias("n"), F.avg("ll").alias("ll"),
        F.sum(r0).alias("a0"), F.sum(r0 * c).alias("b0"), F.sum(r0 * c * c).alias("c0"),
        F.sum(r1).alias("a1"), F.sum(r1 * c).alias("b1"), F.sum(r1 * c * c).alias("c1"),
    )


def _parameters(m) -> tuple:
    # A tiny constant keeps an emptied component defined.
    tiny = 10 * 2.220446049250313e-16
    out = [m["motif"], m["shift"]]
    total = m["a0"] + m["a1"] + 2 * tiny
    for j in "01":
        a = m[f"a{j}"] + tiny
        mu = m[f"b{j}"] / a
        out += [a / total, mu, m[f"c{j}"] / a - mu * mu + REG_COVAR]
    return tuple(out)


def _expect(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Posterior of the high component and log density of every score."""
    c = F.col("s") - F.col("shift")
    dens = lambda j: (
        F.log(f"w{j}") - 0.5 * F.log(F.lit(2 * math.pi) * F.col(f"var{j}"))
        - (c - F.col(f"mu{j}")) * (c - F.col(f"mu{j}")) / (2 * F.col(f"var{j}"))
    )
    both = scores.join(F.broadcast(params), "motif").withColumn("d0", dens(0)).withColumn("d1", dens(1))
    top = F.greatest("d0", "d1")
    return both.withColumn("r", 1 / (1 + F.exp(F.col("d0") - F.col("d1")))).withColumn(
        "ll", top + F.log(F.exp(F.col("d0") - top) + F.exp(F.col("d1") - top))
    )


def _bins(scores: DataFrame) -> pd.DataFrame:
    """(motif, bin, n, a, b, lo, hi): count and first two moments of the scores about the middle of bins
    1 / BINS wide. At most BINS rows for each unit of the range of log loadings, whatever the cells."""
    binned = scores.withColumn("bin", F.floor(F.col("s") * BINS))
    u = F.col("s") - (F.col("bin") + 0.5) / BINS
    return binned.groupBy("motif", "bin").agg(
        F.count("*").alias("n"), F.sum(u).alias("a"), F.sum(u * u).alias("b"), F.min("s").alias("lo"), F.max("s").alias("hi"),
    ).toPandas().sort_values(["motif", "bin"])


def _nodes(bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two scores for each bin, half of its count each, with its mean and variance."""
    n = bins["n"].to_numpy(float)
    mean, square = bins["a"].to_numpy() / n, bins["b"].to_numpy() / n
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    middle = (bins["bin"].to_numpy() + 0.5) / BINS + mean
    return np.concatenate([middle - spread, middle + spread]), np.concatenate([n, n]) / 2


def _step(x: np.ndarray, weight: np.ndarray, params: tuple) -> tuple[dict, float]:
    """Sums of both components over nodes ``x`` and the mean log likelihood under ``params``."""
    d0, d1 = (math.log(w) - 0.5 * math.log(2 * math.pi * var) - (x - mu) ** 2 / (2 * var) for w, mu, var in (params[2:5], params[5:8]))
    top = np.maximum(d0, d1)
    with np.errstate(over="ignore"):
        r = 1 / (1 + np.exp(d0 - d1))
    ll = top + np.log(np.exp(d0 - top) + np.exp(d1 - top))
    sums = {"motif": params[0], "shift": params[1]}
    for j, part in (("0", (1 - r) * weight), ("1", r * weight)):
        sums |= {f"a{j}": part.sum(), f"b{j}": (part * x).sum(), f"c{j}": (part * x * x).sum()}
    return sums, float((ll * weight).sum() / weight.sum())


def fit_mixture(loadings: DataFrame, max_iter: int = 100, tol: float | None = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Two Gaussians on log loadings, per motif over all samples.

    Start: split at the middle between least and largest score, so component 1 is the high one. The
    cells are read twice: once for the moments of narrow bins, once for the exact sums of the split.
    Every step after that works on the bins (two nodes each, exact to the third order in a bin's
    width), whose number depends on the range of the scores alone. A motif stops once its mean log
    likelihood gains less than ``tol``. Returns (parameters, degenerate motifs); ``converged`` tells
    whether a motif stopped by itself within ``max_iter`` steps (null without ``tol``).
    """
    spark = loadings.sparkSession
    scores = _log_scores(loadings).select("motif", "s")
    nodes, flat, cuts = {}, [], []
    for motif, bins in _bins(scores).groupby("motif"):
        x, weight = _nodes(bins)
        total = weight.sum()
        shift = float((x * weight).sum() / total)
        if total < 2 or math.sqrt(((x - shift) ** 2 * weight).sum() / total) < 1e-6:
            flat.append((int(motif), shift))
            continue
        nodes[int(motif)] = x - shift, weight
        cuts.append((int(motif), (float(bins["lo"].min()) + float(bins["hi"].max())) / 2, shift))
    rows = []
    if cuts:
        cut = spark.createDataFrame(cuts, "motif int, cut double, shift double")
        split = scores.join(F.broadcast(cut), "motif").withColumn("r", (F.col("s") > F.col("cut")).cast("double")).withColumn("ll", F.lit(0.0))
        for m in _maximize(split).collect():
            (x, weight), found, last, stopped = nodes[m["motif"]], _parameters(m), None, False
            for _ in range(max_iter):
                sums, ll = _step(x, weight, found)
                found = tuple(map(float, _parameters(sums)))
                stopped = tol is not None and last is not None and abs(ll - last) < tol
                last = ll
                if stopped:
                    break
            rows.append((m["motif"], *found[1:], None if tol is None else stopped))
    params = spark.createDataFrame(rows, PARAMS + ", converged boolean")
    return params, spark.createDataFrame(flat, "motif int, shift double")


def assign_states(loadings: DataFrame, params: DataFrame, degenerate: DataFrame) -> DataFrame:
    """(.., loading, posterior, state); motifs without spread are negative everywhere."""
    scored = _expect(_log_scores(loadings), params)
    # The positive component is the one with the higher mean.
    p = F.when(F.col("mu1") >= F.col("mu0"), F.col("r")).otherwise(1 - F.col("r"))
    live = scored.withColumn("posterior", p).select("sample_id", "cell_id", "motif", "loading", "posterior")
    flat = loadings.join(F.broadcast(degenerate.select("motif")), "motif").select(
        "sample_id", "cell_id", "motif", "loading", F.lit(0.0).alias("posterior")
    )
    return live.unionByName(flat).withColumn("state", F.when(F.col("posterior") > 0.5, "positive").otherwise("negative"))


def mixture_summary(params: DataFrame, degenerate: DataFrame) -> DataFrame:
    live = params.select(
        "motif", (F.col("mu0") + F.col("shift")).alias("mean0"), (F.col("mu1") + F.col("shift")).alias("mean1"),
        F.col("w0").alias("weight0"), F.col("w1").alias("weight1"),
        F.when(F.col("mu1") >= F.col("mu0"), 1).otherwise(0).alias("positive_component"),
    )
    flat = degenerate.select(
        "motif", F.col("shift").alias("mean0"), F.col("shift").alias("mean1"),
        F.lit(1.0).alias("weight0"), F.lit(0.0).alias("weight1"), F.lit(0).alias("positive_component"),
    )
    return live.unionByName(flat)


def celltype_weights(
    loadings: DataFrame, cells: DataFrame, normalize: bool = True, top_n: int | None = None, other: str = "Other"
) -> DataFrame:
    """Loading of each cell type per motif; types beyond the top n are pooled if positive."""
    types = cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type")
    w = loadings.join(types, ["sample_id", "cell_id"]).groupBy("motif", "cell_type").agg(F.sum("loading").alias("weight"))
    if top_n:
        rank = F.row_number().over(Window.partitionBy("motif").orderBy(F.desc("weight"), "cell_type"))
        pooled = F.when(rank > top_n, F.lit(True)).otherwise(F.lit(False))
        w = (
            w.withColumn("_pooled", pooled)
            .groupBy("motif", "_pooled", F.when(F.col("_pooled"), F.lit(other)).otherwise(F.col("cell_type")).alias("cell_type"))
            .agg(F.sum("weight").alias("weight")).where("NOT _pooled OR weight > 0").drop("_pooled")
        )
    if normalize:
        total = F.sum("weight").over(Window.partitionBy("motif"))
        w = w.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))
    return w


def celltype_order(weights: DataFrame) -> list[str]:
    """All cell types by total weight, largest first: they become the columns of one table."""
    rows = weights.groupBy("cell_type").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "cell_type").collect()
    return [r["cell_type"] for r in rows]


def wide_weights(weights: DataFrame) -> DataFrame:
    order = celltype_order(weights)
    return weights.groupBy("motif").pivot("cell_type", order).agg(F.sum("weight")).na.fill(0.0)


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("motif").agg(
        F.count_if(F.col("state") == "positive").alias("positive"), F.count_if(F.col("state") == "negative").alias("negative")
    )


def positive_motifs_per_cell(states: DataFrame, n_motifs: int) -> DataFrame:
    """Number of cells with 0, 1, .. K positive motifs, zero-filled."""
    per_cell = states.groupBy("sample_id", "cell_id").agg(F.count_if(F.col("state") == "positive").alias("n_positive"))
    counts = per_cell.groupBy("n_positive").agg(F.count("*").alias("n_cells"))
    every = states.sparkSession.range(n_motifs + 1).withColumnRenamed("id", "n_positive")
    return every.join(F.broadcast(counts), "n_positive", "left").na.fill(0, ["n_cells"])


def positive_celltypes(
    states: DataFrame, cells: DataFrame, normalize: bool = False, motif_ids: list[int] | None = None, include_untyped: bool = False
) -> DataFrame:
    """Cell types among positive cells per motif, as counts or fractions."""
    types = cells.select("sample_id", "cell_id", "cell_type")
    types = types.na.fill("nan", ["cell_type"]) if include_untyped else types.where(F.col("cell_type").isNotNull())
    chosen = states.where(F.col("state") == "positive")
    if motif_ids is not None:
        chosen = chosen.where(F.col("motif").isin(motif_ids))
    counts = chosen.join(types, ["sample_id", "cell_id"]).groupBy("motif", "cell_type").agg(F.count("*").alias("weight"))
    if normalize:
        counts = counts.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("motif")))
    return counts


def on_cells(states: DataFrame, motif_ids: list[int]) -> DataFrame:
    """(sample_id, cell_id, is_on): positive for all of the motifs."""
    chosen = states.where(F.col("motif").isin(motif_ids))
    return chosen.groupBy("sample_id", "cell_id").agg(F.every(F.col("state") == "positive").alias("is_on"))


def on_summary(states: DataFrame, motif_ids: list[int]) -> DataFrame:
    """ON / OFF cells and percentage per sample, and for all samples (null sample)."""
    return on_cells(states, motif_ids).rollup("sample_id").agg(
        F.count_if("is_on").alias("n_pos"), F.count_if(~F.col("is_on")).alias("n_neg"),
        (F.count_if("is_on") / F.count("*") * 100).alias("pct_on"),
    )


def on_celltypes(states: DataFrame, cells: DataFrame, motif_ids: list[int], top_n: int = 15) -> DataFrame:
    """Most frequent cell types among ON cells."""
    on = on_cells(states, motif_ids).where("is_on").join(
        cells.where(F.col("cell_type").isNotNull()).select("sample_id", "cell_id", "cell_type"), ["sample_id", "cell_id"]
    )
    return on.groupBy("cell_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_type").limit(top_n)


def group_fractions(states: DataFrame, groups: DataFrame) -> DataFrame:
    """Positive fraction per motif and group. ``groups``: (sample_id, cell_id, group, grade)."""
    return states.join(groups, ["sample_id", "cell_id"]).groupBy("motif", "group").agg(
        F.count_if(F.col("state") == "positive").alias("n_positive"), F.count("*").alias("n_cells"),
        F.min("grade").alias("grade"),
    ).withColumn("fraction", F.col("n_positive") / F.col("n_cells"))


def compare_grades(fractions: DataFrame, low: str, high: str) -> DataFrame:
    """Two-sided rank test of group fractions between two grades, per motif.

    Rows are groups (patients), so the rank windows are small.
    """
    w = Window.partitionBy("motif")
    chosen = fractions.where(F.col("grade").isin([low, high]))
    tie = F.count("*").over(Window.partitionBy("motif", "fraction"))
    ranked = (
        chosen.withColumn("_t", tie)
        .withColumn("_rank", F.rank().over(w.orderBy("fraction")) + (F.col("_t") - 1) / 2)
    )
    sums = ranked.groupBy("motif").agg(
        F.sum(F.when(F.col("grade") == high, F.col("_rank")).otherwise(0.0)).alias("r1"),
        F.count_if(F.col("grade") == high).alias("n1"), F.count_if(F.col("grade") == low).alias("n2"),
        F.sum(F.col("_t") * F.col("_t") - F.lit(1)).cast("double").alias("ties"), (F.max("_t") > 1).alias("tied"),
    )
    tested = stats.mann_whitney(sums.where("n1 > 0 AND n2 > 0"), "r1", "n1", "n2", "ties", "tied")
    return tested.select("motif", "n1", "n2", "u1", "pval")
