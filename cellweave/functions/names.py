"""Scalar functions on gene, interaction and motif names (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import small_table

SEP = "|"

# Accepted spellings of the three signaling modes.
AUTOCRINE_WORDS = ["auto", "autocrine", "a"]
JUXTACRINE_WORDS = ["juxta", "juxtacrine", "j"]


def split_complex(name: Column) -> Column:
    """``A_B`` or ``A,B`` to the array of its genes."""
    return F.split(F.translate(name, ",", "_"), "_")


def lri_name(celltype1, celltype2, ligand, receptor, mode, sep: str = SEP) -> Column:
    return F.concat_ws(sep, celltype1, celltype2, ligand, receptor, mode)


def parse_lri(name: Column) -> Column:
    """Interaction name to a struct of its five fields."""
    p = F.split(name, r"\|")
    n = F.size(p)
    unknown = F.lit("unknown")
    at = lambda i: F.get(p, F.lit(i))
    derived = F.when(at(0) == at(1), "autocrine").otherwise("paracrine")
    return F.struct(
        F.when(n >= 4, at(0)).otherwise(unknown).alias("celltype1"),
        F.when(n >= 4, at(1)).otherwise(unknown).alias("celltype2"),
        F.when(n >= 4, at(2)).when(n == 2, at(0)).otherwise(name).alias("ligand"),
        F.when(n >= 4, at(3)).when(n == 2, at(1)).otherwise(name).alias("receptor"),
        F.when(n >= 5, at(4)).when(n == 4, derived).otherwise(unknown).alias("signaling_type"),
    )


def add_lri_components(df: DataFrame, lri_col: str = "lri_name") -> DataFrame:
    """Drop appended gene features, then add the parsed name fields as columns."""
    parsed = df.where(~F.col(lri_col).startswith("GENE")).withColumn("_p", parse_lri(F.col(lri_col)))
    return parsed.select(*df.columns, "_p.*")


def norm_mode(mode: Column) -> Column:
    m = F.lower(F.trim(mode))
    return (
        F.when(m.isin(AUTOCRINE_WORDS), "autocrine")
        .when(m.isin(JUXTACRINE_WORDS), "juxtacrine")
        .otherwise("paracrine")
    )


def extract_lri_genes(
    names: DataFrame, lri_col: str = "lri_name", split_commas: bool = False
) -> DataFrame:
    """Distinct genes named in the ligand and receptor fields of interaction names."""
    p = F.split(F.col(lri_col), r"\|")
    fields = F.array(F.get(p, F.lit(2)), F.get(p, F.lit(3)))
    pattern = "[_,]" if split_commas else "_"
    genes = (
        names.where(F.size(p) >= 4)
        .select(F.explode(fields).alias("field"))
        .select(F.explode(F.split("field", pattern)).alias("gene"))
        .select(F.trim("gene").alias("gene"))
    )
    return genes.where(F.col("gene") != "").distinct()


def safe_name(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, r"[^0-9A-Za-z._-]+", "_"), r"^_+|_+$", "")


def motif_labels(motifs: DataFrame, names: DataFrame, motif_col: str = "motif") -> DataFrame:
    """Attach display label and path slug; motifs without a given name keep their number.

    ``names`` holds (motif, name).
    """
    named = motifs.join(
        small_table(names.select(F.col("motif").alias(motif_col), "name")), motif_col, "left"
    )
    number = F.col(motif_col).cast("string")
    return named.select(
        *motifs.columns,
        F.coalesce("name", F.concat(F.lit("Motif "), number)).alias("label"),
        F.coalesce(F.regexp_replace("name", r"[^\p{L}\p{N}_-]", "_"), number).alias("slug"),
    )


def relabel_motif_key(key: Column, label: Column, slug: Column) -> Column:
    """Result key ``motif_<k><rest>`` to (title, slug) built from the motif's label and slug."""
    rest = F.regexp_extract(key, r"^motif_(\d+)(.*)", 2)
    matched = key.rlike(r"^motif_\d+")
    title = F.trim(F.translate(F.concat(label, rest), "_", " "))
    return F.struct(
        F.when(matched, title).otherwise(key).alias("title"),
        F.when(matched, F.concat(slug, rest)).otherwise(key).alias("key_slug"),
    )


def neg_log10_q(q: Column) -> Column:
    """Volcano height; q at or below 1e-300 is capped at 300."""
    return -F.log10(F.greatest(q, F.lit(1e-300)))


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Case-insensitive regex search for any of the patterns; null counts as no match."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(column.rlike(f"(?i){p}"), F.lit(False))
    return hit
