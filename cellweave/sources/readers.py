"""Readers. Every table is read with an explicit schema and checked once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import schema as S
from cellweave.session import require, with_each


def read_samplesheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sample list CSV as (accepted rows, rejected rows)."""
    raw = spark.read.csv(path, header=True, schema=S.SAMPLESHEET, enforceSchema=False)
    return split_samplesheet(raw)


def split_samplesheet(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sample id has no whitespace; a data path names a Parquet or CSV table."""
    ok = F.coalesce(
        F.col("sample_id").rlike(r"^\S+$") & F.col("data_path").rlike(r"^\S+\.(parquet|csv)$"),
        F.lit(False),
    )
    return raw.where(ok), raw.where(~ok)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet (default) or CSV, with an explicit schema when one is given."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.csv(path, header=True) if path.rstrip("/").endswith(".csv") else reader.parquet(path)


def read_cells(spark: SparkSession, path: str, cell_type_column: str = "cell_type") -> DataFrame:
    """Cells with position and type; fails when either is missing from the file."""
    raw = read_table(spark, path)
    return check_cells(raw, cell_type_column)


def check_cells(raw: DataFrame, cell_type_column: str = "cell_type") -> DataFrame:
    S.require_columns(raw, ["sample_id", "cell_id", "x", "y", cell_type_column], "cells")
    return raw.select(
        "sample_id", F.col("cell_id").cast("long").alias("cell_id"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        F.col(cell_type_column).cast("string").alias("cell_type"),
    )


def select_layer(expression: DataFrame, layer: str = "X") -> DataFrame:
    """Counts of one layer. ``layer`` is a partition column, so only its files are read."""
    name = layer.split(":", 1)[1] if layer.startswith("layers:") else layer
    chosen = expression.where(F.col("layer") == name)
    require(not chosen.limit(1).isEmpty(), f"count layer {layer!r} not found")
    return chosen.drop("layer")


def read_lr_database(spark: SparkSession, path: str, require_type: bool = True) -> DataFrame:
    """LR pairs CSV. Row order is kept in ``lr_id``: it decides ties in pathway lookup.

    The database is one small file, so it is read as one partition and
    ``monotonically_increasing_id`` follows file order.
    """
    raw = spark.read.csv(path, header=True).coalesce(1)
    S.require_columns(raw, ["ligand", "receptor"], "LR database")
    if require_type:
        S.require_columns(raw, ["signaling_type"], "LR database")
    return normalize_lr(raw.withColumn("lr_id", F.monotonically_increasing_id().cast("int")))


def normalize_lr(raw: DataFrame) -> DataFrame:
    """Fill the optional columns: a missing signaling type is ``Unknown``."""
    kind = F.col("signaling_type") if "signaling_type" in raw.columns else F.lit(None).cast("string")
    pathway = F.col("pathway") if "pathway" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        F.col("lr_id").cast("int").alias("lr_id"), "ligand", "receptor",
        F.coalesce(kind, F.lit("Unknown")).alias("signaling_type"),
        pathway.alias("pathway"),
    )


def typed_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("cell_type").isNotNull())


def attach_cell_metadata(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill missing cell types from an external table, by cell key."""
    meta = metadata.select("sample_id", "cell_id", F.col("cell_type").alias("_meta_type"))
    return cells.join(meta, ["sample_id", "cell_id"], "left").select(
        "sample_id", "cell_id", "x", "y", F.coalesce("cell_type", "_meta_type").alias("cell_type")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Any result table written by this library (partition columns are discovered)."""
    return spark.read.parquet(path)


def read_mask(wide: DataFrame, genes: DataFrame, cell_types: list[str]) -> DataFrame:
    """Gene x cell type 0/1 matrix to long form over the current genes; missing is false."""
    long = wide.unpivot("gene", cell_types, "cell_type", "is_marker")
    types = long.select("cell_type").distinct()
    return (
        with_each(genes.select("gene").distinct(), types)
        .join(long, ["gene", "cell_type"], "left")
        .select("gene", "cell_type", F.coalesce(F.col("is_marker").cast("boolean"), F.lit(False)).alias("is_marker"))
    )
