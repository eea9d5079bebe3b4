"""Motif tables: scored factors, leading interactions, cell-type networks, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.names import add_lri_components, matches_any, norm_mode
from cellweave.operators import lrdb
from cellweave.session import require, small_table, with_each

PAIR = ["celltype1", "celltype2"]


def column_means(matrix: DataFrame, n_regions: DataFrame) -> DataFrame:
    """Mean of a column over all regions, zeros included."""
    sums = matrix.groupBy("lri_idx").agg(F.sum("value").alias("_s"))
    return with_each(sums, n_regions).select("lri_idx", (F.col("_s") / F.col("n_regions")).alias("mean"))


def lri_motifs(factors: DataFrame, columns: DataFrame, means: DataFrame) -> DataFrame:
    """Factor, mean and parsed name of every (column, motif) with a positive mean."""
    named = columns.select("lri_idx", "lri_name").join(means, "lri_idx").where(F.col("mean") > 0)
    return add_lri_components(factors.join(named, "lri_idx")).select(
        "lri_idx", "motif", "lri_name", "factor", "mean", *PAIR, "ligand", "receptor", "signaling_type"
    )


def lr_prevalence(df: DataFrame) -> DataFrame:
    """Sum of column means per (ligand, receptor), each column counted once."""
    once = df.select("lri_idx", "ligand", "receptor", "mean").dropDuplicates(["lri_idx"])
    return once.groupBy("ligand", "receptor").agg(F.sum("mean").alias("lr_global_mean"))


def add_scores(df: DataFrame, scales: DataFrame, eps: float = 1.0) -> DataFrame:
    g = F.col("lr_global_mean") + eps
    return (
        df.join(small_table(scales), "motif")
        .join(small_table(lr_prevalence(df)), ["ligand", "receptor"])
        .withColumn("factor_rescaled", F.col("factor") * F.col("w_max"))
        .withColumn("factor_lrnorm", F.col("factor") / g)
        .withColumn("score", F.col("factor_rescaled") / g)
    )


def exclude_celltypes(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.where(~(matches_any(F.col("celltype1"), patterns) | matches_any(F.col("celltype2"), patterns)))


def only_motif(df: DataFrame, motif: int, sender: str | None = None, receiver: str | None = None) -> DataFrame:
    out = df.where(F.col("motif") == motif)
    if sender is not None:
        out = out.where(F.col("celltype1") == sender)
    if receiver is not None:
        out = out.where(F.col("celltype2") == receiver)
    require(not out.limit(1).isEmpty(), f"no rows for motif {motif}, sender {sender}, receiver {receiver}")
    return out


def only_motifs(df: DataFrame, motif_ids: list[int]) -> DataFrame:
    out = df.where(F.col("motif").isin(motif_ids))
    require(not out.limit(1).isEmpty(), f"no motif matches {motif_ids}")
    return out


def only_mode(df: DataFrame, mode: str) -> DataFrame:
    return df.where(norm_mode(F.col("signaling_type")) == norm_mode(F.lit(mode)))


def diagnostics(w: DataFrame, v: DataFrame) -> DataFrame:
    """Coverage and contribution of each motif after rescaling, as fractions."""
    per_w = w.groupBy("motif").agg(F.sum("loading").alias("sw"), F.max("loading").alias("mx"))
    per_v = v.groupBy("motif").agg(F.sum("factor").alias("sv"))
    scale = F.when(F.col("mx") == 0, F.lit(1.0)).otherwise(F.col("mx"))
    both = per_w.join(per_v, "motif").select(
        "motif", (F.col("sw") / scale).alias("coverage"), (F.col("sw") * F.col("sv")).alias("contribution")
    )
    share = lambda c: F.col(c) / (F.sum(c).over(Window.partitionBy()) + 1e-10)
    return both.select("motif", "coverage", share("coverage").alias("coverage_fraction"), "contribution", share("contribution").alias("contribution_fraction"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, lo, n): equal-width bins between least and greatest value, the last closed."""
    v = df.select(value.cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("v_lo"), F.max("v").alias("v_hi"))
    width = (F.col("v_hi") - F.col("v_lo")) / bins
    raw = F.floor((F.col("v") - F.col("v_lo")) / width).cast("int")
    placed = with_each(v, ends).select(
        F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).alias("bin"), "v_lo", width.alias("width")
    )
    return placed.groupBy("bin", "v_lo", "width").agg(F.count("*").alias("n")).select(
        "bin", (F.col("v_lo") + F.col("bin") * F.col("width")).alias("lo"), "n"
    )


def participation(w: DataFrame, v: DataFrame, row_keys: list[str], bins: int = 100) -> tuple[DataFrame, DataFrame]:
    """Histograms of column totals over motifs and of region totals over motifs."""
    by_col = v.groupBy("lri_idx").agg(F.sum("factor").alias("total"))
    by_row = w.groupBy(*row_keys).agg(F.sum("loading").alias("total"))
    return histogram(by_col, F.col("total"), bins), histogram(by_row, F.col("total"), bins)


def sparsity(w: DataFrame, v: DataFrame, threshold: float = 1e-6) -> DataFrame:
    share = lambda df, c, name: df.agg(F.avg((F.col(c) < threshold).cast("double")).alias("share")).select(F.lit(name).alias("matrix"), "share")
    return share(w, "loading", "loadings").unionByName(share(v, "factor", "factors"))


def factor_scatter(df: DataFrame, motif: int | None = None) -> DataFrame:
    """Factor against column mean (all motifs) or pair background (one motif)."""
    if motif is None:
        return df.select("lri_idx", "motif", F.col("factor").alias("x"), F.col("mean").alias("y"))
    return df.where(F.col("motif") == motif).select("lri_idx", "motif", F.col("factor").alias("x"), F.col("lr_global_mean").alias("y"))


def pair_matrix(df: DataFrame, motifs: list[int], factor: str = "factor", exclude: list[str] | None = None) -> DataFrame:
    """Cell pair x motif sums, one column per motif."""
    kept = exclude_celltypes(df, exclude) if exclude else df
    wide = kept.withColumn("cell_pair", F.concat_ws("|", *PAIR)).groupBy("cell_pair").pivot("motif", motifs).agg(F.sum(factor))
    return wide.select("cell_pair", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"motif_{m}") for m in motifs])


def communication_matrix(df: DataFrame, receivers: list[str], factor: str = "factor", exclude: list[str] | None = None) -> DataFrame:
    """Sender x receiver sums per motif, one column per receiver."""
    kept = exclude_celltypes(df, exclude) if exclude else df
    wide = kept.groupBy("motif", "celltype1").pivot("celltype2", receivers).agg(F.sum(factor))
    return wide.select("motif", "celltype1", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in receivers])


def pathway_totals(df: DataFrame, top_n: int = 20, factor: str = "factor") -> DataFrame:
    """Leading (sender, receiver, pathway) per motif with its first two ligands and receptors."""
    def first_two(c: str) -> Column:
        in_order = F.sort_array(F.collect_list(F.struct("lri_idx", F.col(c).alias("g"))))
        return F.array_join(F.slice(F.array_distinct(in_order["g"]), 1, 2), ", ")

    totals = df.groupBy("motif", *PAIR, "pathway").agg(
        F.sum(factor).alias("weight"), first_two("ligand").alias("ligands"), first_two("receptor").alias("receptors")
    )
    return top_per_motif(totals, "weight", top_n, [*PAIR, "pathway"])


def top_per_motif(df: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("motif").orderBy(F.desc(value), *ties))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def top_interactions(df: DataFrame, n: int = 30, factor: str = "factor") -> DataFrame:
    """Best row per (mode, receptor, sender, receiver), then the best n of each motif."""
    key = ["motif", "signaling_type", "receptor", *PAIR]
    order = Window.partitionBy(*key).orderBy(F.desc(factor), "lri_idx")
    best = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")
    return top_per_motif(best, factor, n, ["lri_idx"])


def top_pairs(df: DataFrame, n: int = 25, factor: str = "factor") -> DataFrame:
    sums = df.groupBy("motif", *PAIR).agg(F.sum(factor).alias("weight"))
    return top_per_motif(sums, "weight", n, PAIR)


def network_edges(df: DataFrame, top_n: int = 200, factor: str = "factor", mode: str | None = None) -> DataFrame:
    """(motif, celltype1, celltype2, weight) over the top interactions of each motif."""
    kept = only_mode(df, mode) if mode else df
    top = top_per_motif(kept, factor, top_n, ["lri_idx"])
    return top.groupBy("motif", *PAIR).agg(F.sum(factor).alias("weight"))


def edges_above(edges: DataFrame, threshold: float) -> DataFrame:
    """A threshold of 0 or less keeps everything."""
    return edges.where(F.col("weight") > threshold) if threshold > 0 else edges


def edge_gate(df: DataFrame, top_n: int = 200, factor: str = "factor", threshold: float = 1500) -> DataFrame:
    edges = network_edges(df, top_n, factor)
    return edges.where(F.col("weight") > threshold).select("motif", *PAIR)


def apply_gate(edges: DataFrame, gate: DataFrame) -> DataFrame:
    """Keep gated edges; a motif whose gate is empty keeps all its edges."""
    gated = edges.join(gate, ["motif", *PAIR], "left_semi")
    return gated.unionByName(edges.join(gate.select("motif").distinct(), "motif", "left_anti"))


def outlier_edges(edges: DataFrame, max_celltypes: int = 4, z: float = 3.5) -> DataFrame:
    """Edges of outlying weight, taken greedily while their endpoints stay few.

    At most (cell types)^2 edges per motif are folded in weight order.
    """
    if max_celltypes < 2:
        return edges.limit(0)
    motif = Window.partitionBy("motif")
    w = F.col("weight")
    scored = (
        edges.withColumn("_med", F.median("weight").over(motif))
        .withColumn("_dev", F.abs(w - F.col("_med")))
        .withColumn("_mad", F.median("_dev").over(motif))
        .withColumn("_sd", F.stddev_pop("weight").over(motif))
        .withColumn("_avg", F.avg("weight").over(motif))
    )
    score = (
        F.when(F.col("_mad") > 0, 0.6745 * (w - F.col("_med")) / F.col("_mad"))
        .when(F.col("_sd") > 0, (w - F.col("_avg")) / F.col("_sd")).otherwise(F.lit(0.0))
    )
    out = scored.withColumn("score", score).where(F.col("score") > z)
    listed = out.groupBy("motif").agg(F.sort_array(F.collect_list(
        F.struct((-w).alias("neg"), *PAIR, "score")
    )).alias("es"))

    def take(state: Column, e: Column) -> Column:
        ends = F.array_distinct(F.concat(state["nodes"], F.array(e["celltype1"], e["celltype2"])))
        fits = F.size(ends) <= max_celltypes
        return F.when(fits, F.struct(F.concat(state["kept"], F.array(e)).alias("kept"), ends.alias("nodes"))).otherwise(state)

    empty = F.struct(
        F.filter("es", lambda _: F.lit(False)).alias("kept"), F.array().cast("array<string>").alias("nodes")
    )
    return listed.select("motif", F.inline(F.aggregate("es", empty, take)["kept"])).select(
        "motif", *PAIR, (-F.col("neg")).alias("weight"), "score"
    )


def edge_labels(df: DataFrame, edges: DataFrame, top_n: int = 200, factor: str = "factor") -> DataFrame:
    """Up to three LR pairs per edge: those among the motif's 20 best receptors, else the best."""
    by_receptor = Window.partitionBy("motif", "receptor").orderBy(F.desc(factor), "lri_idx")
    best = df.withColumn("_r", F.row_number().over(by_receptor)).where(F.col("_r") == 1)
    top20 = top_per_motif(best, factor, 20, ["lri_idx"]).select("motif", *PAIR, "ligand", "receptor", F.lit(True).alias("in_top")).distinct()
    listed = top_per_motif(df, factor, top_n, ["lri_idx"]).drop("rank").join(edges.select("motif", *PAIR), ["motif", *PAIR], "left_semi")
    marked = listed.join(top20, ["motif", *PAIR, "ligand", "receptor"], "left")
    edge = Window.partitionBy("motif", *PAIR)
    has_top = F.max(F.coalesce("in_top", F.lit(False))).over(edge)
    usable = marked.withColumn("_any", has_top).where(~F.col("_any") | F.col("in_top"))
    ranked = usable.withColumn("_r", F.row_number().over(edge.orderBy(F.desc(factor), "lri_idx"))).where(F.col("_r") <= 3)
    ordered = F.sort_array(F.collect_list(F.struct("_r", F.concat_ws("-", "ligand", "receptor").alias("t"))))
    return ranked.groupBy("motif", *PAIR).agg(F.array_join(ordered["t"], "\n").alias("label"))


def network(df: DataFrame, top_n: int = 200, factor: str = "factor", mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with all LR pairs of their cell pair (strongest first), and nodes per motif."""
    kept = only_mode(df, mode) if mode else df
    edges = network_edges(kept, top_n, factor)
    entries = F.sort_array(F.collect_list(F.struct(
        (-F.col(factor)).alias("neg"), "lri_idx", "ligand", "receptor", norm_mode(F.col("signaling_type")).alias("mode")
    )))
    lists = kept.groupBy("motif", *PAIR).agg(entries.alias("lr_pairs"))
    bounds = small_table(edges.agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")))
    full = with_each(edges.join(lists, ["motif", *PAIR]), bounds)
    nodes = edges.select("motif", F.explode(F.array(*PAIR)).alias("cell_type")).distinct()
    return full, nodes


def process_results(
    w: DataFrame, v: DataFrame, columns: DataFrame, matrix: DataFrame, n_regions: DataFrame, lr: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Everything derived from a fitted factorization: rescaled factors and scored motifs."""
    from cellweave.operators.factorize import rescale

    w2, v2, scales = rescale(w, v)
    table = lri_motifs(v, columns, column_means(matrix, n_regions))
    if lr is not None:
        table = lrdb.annotate_pathways(table, lr)
    return {
        "loadings": w, "factors": v, "loadings_rescaled": w2, "factors_rescaled": v2,
        "scales": scales, "lri_motifs": add_scores(table, scales),
    }
