"""Writers. Facts go to partitioned Parquet; small dimensions to one Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cleaned_shuffles


def write_facts(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Write Parquet. Rows are gathered by partition first, so a folder gets few files; the
    rebalance lets AQE split a partition value that holds a large share of all rows. That exchanges
    every row: a table far larger than what it is made of is written without partitions, task by task.
    The shuffle files of the query are deleted when it is written."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with cleaned_shuffles(df.sparkSession):
        writer.parquet(path)
    return path


def write_region_matrix(
    matrix: DataFrame, lri: DataFrame, parameters: DataFrame, metadata: DataFrame,
    sample_info: DataFrame | None, out_dir: str, prefix: str = "patch",
) -> dict[str, str]:
    """Matrix, its column dimension, parameters, region metadata and sample totals."""
    base = out_dir.rstrip("/")
    paths = {
        "matrix": write_facts(matrix, f"{base}/{prefix}_lri_matrix", ["sample_id"]),
        "columns": write_facts(lri, f"{base}/{prefix}_lri_columns"),
        "parameters": write_facts(parameters, f"{base}/analysis_parameters"),
        "metadata": write_facts(metadata, f"{base}/{prefix}_metadata", ["sample_id"]),
    }
    if sample_info is not None:
        paths["sample_info"] = write_facts(sample_info, f"{base}/sample_info")
    return paths


def wide_loadings(loadings: DataFrame, motifs: list[int]) -> DataFrame:
    """One row per cell, one column per motif."""
    return (
        loadings.groupBy("sample_id", "cell_id").pivot("motif", motifs).agg(F.first("loading"))
        .select("sample_id", "cell_id", *[F.col(str(k)).alias(f"motif_{k}") for k in motifs])
    )


def wide_mask(markers: DataFrame, genes: DataFrame, cell_types: list[str]) -> DataFrame:
    """Marker rows to a gene x cell type 0/1 matrix over all genes."""
    flags = [
        F.coalesce(F.max(F.when(F.col("cell_type") == t, 1)), F.lit(0)).alias(t) for t in cell_types
    ]
    return (
        genes.select("gene").distinct().join(markers.select("gene", "cell_type"), "gene", "left")
        .groupBy("gene").agg(*flags)
    )


def write_de(de: DataFrame, path: str) -> str:
    """DE rows partitioned by (motif, cell_type); existing results are never overwritten."""
    return write_facts(de, path, ["motif", "cell_type"])
