"""Table schemas, checked once when a table enters the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CELLS = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("cell_type", T.StringType()),
])
GENES = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("gene", T.StringType()),
])
EXPRESSION = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("gene", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("count", T.LongType()),
])
LR_PAIRS = T.StructType([
    T.StructField("lr_id", T.IntegerType()),
    T.StructField("ligand", T.StringType()),
    T.StructField("receptor", T.StringType()),
    T.StructField("signaling_type", T.StringType()),
    T.StructField("pathway", T.StringType()),
])
SAMPLESHEET = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("data_path", T.StringType()),
])


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; found {df.columns}")
    return df
