"""Session-level helpers: shared folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension tables (LR database, per-sample extents, cell types, model columns) are
# broadcast only when they are proven to stay below this many rows.
BROADCAST_ROWS = 200_000

# A shuffle is cut into at least this many parts; the adaptive planner joins neighbors again up to PART_MB each.
# Up to 200 parts go to files of their own, beyond that the writers sort all rows of a task in memory.
SHUFFLE_PARTS = 200
PART_MB = 8
# Bytes of a file read by one task.
SPLIT_MB = 16


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def fine_shuffles(spark: SparkSession) -> None:
    """Let the number of tasks follow the bytes read and shuffled, so that a task's sorts and hash maps do not
    grow with the input. A session that asks for more parts, or smaller ones, keeps its own setting."""
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    asked = spark.conf.get(parts, None) or spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(parts, str(max(int(asked), SHUFFLE_PARTS)))
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for size, mb in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_MB), ("spark.sql.files.maxPartitionBytes", SPLIT_MB)):
        if bytes_of(spark.conf.get(size)) > mb << 20:
            spark.conf.set(size, f"{mb}m")


#: Spark then deletes the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Queries that end inside the block leave no shuffle files behind."""
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Reliable checkpoint: later stages read the stored rows, also after executor loss.

    With ``keep_layout`` the stored table stays known to be partitioned as it is, so that joins and
    groupings on its keys need no exchange. The adaptive planner reports no layout, so this one plan
    is made without it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    if not keep_layout:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint made by ``cut_lineage`` that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a dimension once and keep it as a local table, provided it is proven small.

    At most ``max_rows + 1`` rows are fetched; a larger table is returned as it came.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return df.sparkSession.createDataFrame(head, df.schema)


def small_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension proven small; otherwise leave the join to a shuffle, which
    AQE may still split on skew."""
    copy = local_copy(df, max_rows)
    return df if copy is df else F.broadcast(copy)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def with_each(df: DataFrame, dim: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Repeat every row for each row of a dimension (types, motifs, totals).

    The dimension is gathered into one array, a single row that every task holds, so it must fit
    in memory; ``max_rows`` refuses a larger one.
    """
    if max_rows is not None:
        require(dim.limit(max_rows + 1).count() <= max_rows, f"dimension {dim.columns} holds more than {max_rows} rows")
    items = dim.agg(F.collect_list(F.struct(*dim.columns)).alias("_items")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(items), "_one")
    return joined.select(*[F.col(c) for c in df.columns], F.inline("_items"))
