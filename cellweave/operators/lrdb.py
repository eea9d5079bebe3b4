"""Ligand-receptor database: complexes, usable pairs, interaction space, pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.names import lri_name, split_complex
from cellweave.session import local_copy, require, small_table, with_each

# Fixed value: the one signaling type that means direct contact.
CONTACT = "Cell-Cell Contact"


def pair_genes(lr: DataFrame) -> DataFrame:
    """(lr_id, side, gene, n_genes), one row per distinct gene of each complex."""
    sides = lr.select(
        "lr_id",
        F.explode(F.array(
            F.struct(F.lit("L").alias("side"), F.array_distinct(split_complex(F.col("ligand"))).alias("genes")),
            F.struct(F.lit("R").alias("side"), F.array_distinct(split_complex(F.col("receptor"))).alias("genes")),
        )).alias("s"),
    )
    return sides.select("lr_id", "s.side", F.explode("s.genes").alias("gene"), F.size("s.genes").alias("n_genes"))


def database_genes(lr: DataFrame) -> DataFrame:
    """All genes the database refers to, on either side."""
    genes = pair_genes(lr).select("gene").where(F.col("gene") != "")
    return genes.distinct()


def pair_coverage(lr: DataFrame, panel: DataFrame) -> DataFrame:
    """Per complete pair: are all ligand genes, and all receptor genes, in the panel?"""
    known = panel.select("gene").distinct().withColumn("found", F.lit(True))
    return (
        pair_genes(lr.where(F.col("ligand").isNotNull() & F.col("receptor").isNotNull()))
        .join(known, "gene", "left")
        .groupBy("lr_id")
        .agg(
            F.every(F.coalesce("found", F.lit(False)) | (F.col("side") != "L")).alias("ligand_ok"),
            F.every(F.coalesce("found", F.lit(False)) | (F.col("side") != "R")).alias("receptor_ok"),
        )
    )


def usable_pairs(lr: DataFrame, panel: DataFrame, dedupe: bool = True) -> DataFrame:
    """Pairs whose genes are all in the panel (relational division over exploded genes)."""
    covered = pair_coverage(lr, panel).where("ligand_ok AND receptor_ok").select("lr_id")
    kept = lr.join(covered, "lr_id", "left_semi").withColumn(
        "signaling_type", F.coalesce("signaling_type", F.lit("Unknown"))
    )
    return local_copy(dedupe_pairs(kept) if dedupe else kept)


def dedupe_pairs(lr: DataFrame) -> DataFrame:
    """Keep the first row of each (ligand, receptor, type)."""
    keys = ["ligand", "receptor", "signaling_type"]
    rest = [c for c in lr.columns if c not in keys]
    first = lr.groupBy(*keys).agg(F.min_by(F.struct(*rest), "lr_id").alias("r"))
    return first.select(*[F.col(f"r.{c}") if c in rest else F.col(c) for c in lr.columns])


def require_unique_pairs(lr: DataFrame) -> None:
    """Strict mode: duplicated rows would give two columns the same name."""
    repeated = lr.groupBy("ligand", "receptor", "signaling_type").count().where("count > 1")
    require(repeated.limit(1).isEmpty(), "LR database repeats a (ligand, receptor, signaling_type)")


def pair_overlap(lr: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: pairs covered on the ligand side, receptor side, both, or neither."""
    c = pair_coverage(lr, panel)
    n = F.count_if
    return c.agg(
        F.count("*").alias("n_pairs"),
        n(F.col("ligand_ok")).alias("ligand_covered"),
        n(F.col("receptor_ok")).alias("receptor_covered"),
        n(F.col("ligand_ok") & F.col("receptor_ok")).alias("both"),
        n(F.col("ligand_ok") & ~F.col("receptor_ok")).alias("only_ligand"),
        n(~F.col("ligand_ok") & F.col("receptor_ok")).alias("only_receptor"),
        n(~F.col("ligand_ok") & ~F.col("receptor_ok")).alias("neither"),
        (n(F.col("ligand_ok") & F.col("receptor_ok")) / F.count("*") * 100).alias("pct_usable"),
    )


def gene_overlap(panel: DataFrame, lr: DataFrame) -> DataFrame:
    """One row: genes in the data only, in the database only, in both, and coverage."""
    data = panel.select("gene").distinct().withColumn("d", F.lit(1))
    base = database_genes(lr).withColumn("b", F.lit(1))
    j = data.join(base, "gene", "full_outer")
    both = F.count_if(F.col("d").isNotNull() & F.col("b").isNotNull())
    return j.agg(
        F.count_if(F.col("b").isNull()).alias("data_only"),
        F.count_if(F.col("d").isNull()).alias("db_only"),
        both.alias("both"),
        F.count("b").alias("n_db"),
        F.coalesce(F.try_divide(both, F.count("b")) * 100, F.lit(0.0)).alias("pct_coverage"),
    )


def modes_of(signaling_type: Column, same_type: Column, contact: str = CONTACT) -> Column:
    return (
        F.when(signaling_type == contact, F.array(F.lit("juxtacrine")))
        .when(same_type, F.array(F.lit("autocrine"), F.lit("paracrine")))
        .otherwise(F.array(F.lit("paracrine")))
    )


def lri_space(lr: DataFrame, cell_types: DataFrame, contact: str = CONTACT) -> DataFrame:
    """Every possible interaction column: pair x sender type x receiver type x mode.

    This is a dimension built on request (both inputs are small); counting never needs it.
    """
    senders = cell_types.select(F.col("cell_type").alias("celltype1"))
    receivers = cell_types.select(F.col("cell_type").alias("celltype2"))
    space = with_each(with_each(lr, senders), receivers).withColumn(
        "mode", F.explode(modes_of(F.col("signaling_type"), F.expr("celltype1 = celltype2"), contact))
    )
    return number_lri(space.select("lr_id", "celltype1", "celltype2", "ligand", "receptor", "mode"))


def number_lri(keys: DataFrame) -> DataFrame:
    """Add the column index, in (database, sender, receiver, mode) order, and the name.

    Columns rank within their pair; running totals over the pairs of the database shift
    them, so the whole column space is never one window.
    """
    within = Window.partitionBy("lr_id").orderBy("celltype1", "celltype2", "mode")
    before = Window.orderBy("lr_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_table(
        keys.groupBy("lr_id").agg(F.count("*").alias("_n"))
        .select("lr_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    ranked = keys.withColumn("_r", F.row_number().over(within) - 1).join(offsets, "lr_id")
    return ranked.select(
        *keys.columns, (F.col("_r") + F.col("_before")).cast("int").alias("lri_idx"),
        lri_name("celltype1", "celltype2", "ligand", "receptor", "mode").alias("lri_name"),
    )


def pathway_map(lr: DataFrame) -> DataFrame:
    """(ligand, receptor) to pathway: full names and every ``_``-split gene combination.

    ``ord`` is the position of a key's first appearance (fuzzy lookup order); the pathway
    is the one of its last appearance (exact lookup).
    """
    # Split combinations of a row precede its full name.
    genes = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "_"))
    combos = lr.select(
        "lr_id", "pathway", F.posexplode(genes("ligand")).alias("i", "lig"), genes("receptor").alias("recs")
    ).select("lr_id", "pathway", "i", "lig", F.posexplode("recs").alias("j", "rec"))
    full = lr.where(F.col("ligand").isNotNull() & F.col("receptor").isNotNull()).select(
        "lr_id", "pathway", F.lit(1 << 20).alias("i"), F.col("ligand").alias("lig"),
        F.lit(0).alias("j"), F.col("receptor").alias("rec"),
    )
    rows = combos.unionByName(full).withColumn("ord", F.struct("lr_id", "i", "j"))
    return rows.groupBy("lig", "rec").agg(
        F.min("ord").alias("ord"), F.max_by("pathway", "ord").alias("pathway")
    )


def _containing(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """Pairs of distinct names (x, y) of which one is a part of the other.

    Names are short, so every part of each name is listed and matched by equality.
    """
    def parts(c: str) -> Column:
        size = F.length(c)
        each = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
            F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col(c), i, n),
        )))
        return F.explode(F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.array(F.lit("")), each))))

    xs, ys = a.select(x).distinct(), b.select(y).distinct()
    inside = xs.select(x, parts(x).alias("_part")).join(ys, F.col("_part") == F.col(y)).select(x, y)
    around = ys.select(y, parts(y).alias("_part")).join(xs, F.col("_part") == F.col(x)).select(x, y)
    return inside.union(around).distinct()


def annotate_pathways(df: DataFrame, lr: DataFrame) -> DataFrame:
    """Add ``pathway`` by exact pair, else by first fuzzy containment, else ``Unknown``.

    Only distinct (ligand, receptor) pairs are looked up, and only those without an exact
    entry are searched. Containment is found name by name through equal parts, so every join
    is one on equality.
    """
    lookup = small_table(pathway_map(lr))
    pairs = df.select("ligand", "receptor").distinct()
    exact = pairs.join(
        lookup.select(F.col("lig").alias("ligand"), F.col("rec").alias("receptor"), "pathway"),
        ["ligand", "receptor"], "left",
    ).where(F.col("pathway").isNotNull() & (F.col("pathway") != ""))
    rest = pairs.join(exact, ["ligand", "receptor"], "left_anti")
    near = (
        rest.join(_containing(rest, "ligand", lookup, "lig"), "ligand")
        .join(_containing(rest, "receptor", lookup, "rec"), "receptor")
    )
    fuzzy = near.join(lookup, ["lig", "rec"]).groupBy("ligand", "receptor").agg(F.min_by("pathway", "ord").alias("pathway"))
    found = small_table(exact.unionByName(fuzzy))
    return df.join(found, ["ligand", "receptor"], "left").withColumn(
        "pathway", F.coalesce("pathway", F.lit("Unknown"))
    )
