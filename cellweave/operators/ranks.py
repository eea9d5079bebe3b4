"""Average ranks and per-group samples that never put one whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut_lineage


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, rank): the average rank of every distinct value in its group.

    Equal values are counted first. The distinct values are then range-partitioned over
    all groups at once; running counts inside a partition plus the totals of earlier
    partitions give the ranks. Partition numbers are stored with the rows before they are
    used, so a recomputed task cannot see other range bounds.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    placed = cut_lineage(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_part").agg(F.sum("n").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    running = Window.partitionBy("_part", *group).orderBy(value)
    upto = placed.withColumn("_upto", F.sum("n").over(running))
    return upto.join(totals, [*group, "_part"]).select(
        *group, value, "n", (F.col("_before") + F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank")
    )


def rank_rows(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Every row with the average rank of its value in its group."""
    ranks = average_ranks(df, group, value).select(*group, value, "rank")
    return df.join(ranks, [*group, value])


def sample_group(df: DataFrame, group: list[str], n: int, key: list[str], seed: int = 0, salts: int = 64) -> DataFrame:
    """At most ``n`` rows per group, without replacement, in the order of a seeded hash.

    Each salt keeps its own first ``n`` rows, so the final window sees at most
    ``n * salts`` rows of a group, whatever its size.
    """
    order = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    hashed = df.withColumn("_h", order).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_h", *key))
    first = hashed.withColumn("_r", rank(*group, "_salt")).where(F.col("_r") <= n)
    return first.withColumn("_r", rank(*group)).where(F.col("_r") <= n).drop("_h", "_salt", "_r")
