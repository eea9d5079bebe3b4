"""Bayesian Poisson factorization of the region x interaction counts, and projection.

y_ij ~ Poisson(sum_k theta_ik phi_jk) with Gamma(alpha, alpha beta) priors, fitted by
coordinate ascent on Gamma posteriors. Only nonzero counts and column sums are needed, so
a half step is one join and one grouped sum. Factors are tables with one column per
component; K is a small constant, rows and columns may be of any number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.special import DIGAMMA_SERIES, SHIFT, digamma, log_gamma
from cellweave.session import BROADCAST_ROWS, cut_lineage, forget, local_copy, small_table, with_each

ALPHA = 0.1
# Nonzeros updated at once in a projection task (times K doubles of working memory).
MAX_NONZEROS = 1_000_000
# Nonzeros whose shares are worked out at once while fitting.
BLOCK_NONZEROS = 200_000
# Nonzeros of a fitting task: at least, while there are tasks for all cores, and at most.
TASK_NONZEROS = 20_000, 2_000_000
# Columns whose sums are reduced as one array, and iterations between two reliable copies of the rows' state.
CHUNK, STORE_EVERY = 4096, 10


def hash_start(keys: list[str], seed: int) -> Callable[[int], Column]:
    """Starting value in [0.5, 1.5) per key and component, equal on every run."""
    def start(k: int) -> Column:
        return 0.5 + F.pmod(F.xxhash64(*[F.col(c) for c in keys], F.lit(k), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)

    return start


def _names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def _start(dim: DataFrame, keys: list[str], k: int, start: Callable[[int], Column]) -> DataFrame:
    values = [start(i) for i in range(k)]
    return dim.select(
        *keys, *[v.alias(f"g{i}") for i, v in enumerate(values)], *[v.alias(f"e{i}") for i, v in enumerate(values)]
    )


def _sums(factor: DataFrame, k: int) -> dict:
    """Column sums of expectations and the rate hyperparameter 1 / mean: one small row."""
    row = factor.agg(F.count("*").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(k)]).first()
    e = [float(row[f"e{i}"]) for i in range(k)]
    return {"n": row["n"], "e": e, "beta": row["n"] * k / sum(e)}


def _shares(k: int) -> tuple[list[Column], Column]:
    """Expected counts of a nonzero per component, and its log intensity."""
    products = [F.col(f"rg{i}") * F.col(f"cg{i}") for i in range(k)]
    total = products[0]
    for p in products[1:]:
        total = total + p
    return [F.col("value") * p / F.col("total") for p in products], total


def _as(df: DataFrame, keys: list[str], prefix: str, k: int) -> DataFrame:
    return df.select(*keys, *[F.col(f"g{i}").alias(f"{prefix}g{i}") for i in range(k)])


def _half_step(
    nnz: DataFrame, rows: DataFrame, cols: DataFrame, dim: DataFrame, keys: list[str],
    row_keys: list[str], col_keys: list[str], other: dict, beta: float, alpha: float, k: int, broadcast_rows: int,
) -> DataFrame:
    """New shape, rate, G and E of one mode, given both modes' current G.

    The column side is broadcast only if it is proven small; otherwise both joins shuffle.
    A dimension row without any nonzero keeps the prior shape.
    """
    shares, total = _shares(k)
    joined = (
        nnz.join(small_table(_as(cols, col_keys, "c", k), broadcast_rows), col_keys)
        .join(_as(rows, row_keys, "r", k), row_keys)
        .withColumn("total", total)
    )
    summed = joined.groupBy(*keys).agg(
        *[F.sum(s).alias(f"s{i}") for i, s in enumerate(shares)],
        F.sum(F.col("value") * F.log("total")).alias("fit"),
    )
    shaped = dim.join(summed, keys, "left").na.fill(0.0)
    shape = [F.lit(alpha) + F.col(f"s{i}") for i in range(k)]
    rate = [F.lit(alpha * beta + other["e"][i]) for i in range(k)]
    return shaped.select(
        *keys, "fit",
        *[shape[i].alias(f"shape{i}") for i in range(k)], *[rate[i].alias(f"rate{i}") for i in range(k)],
    ).select(
        "*",
        *[(F.exp(digamma(F.col(f"shape{i}"))) / F.col(f"rate{i}")).alias(f"g{i}") for i in range(k)],
        *[(F.col(f"shape{i}") / F.col(f"rate{i}")).alias(f"e{i}") for i in range(k)],
    )


def _prior_terms(factor: DataFrame, beta: float, alpha: float, k: int) -> float:
    """Prior and entropy part of the bound for one mode (one aggregated number)."""
    term = F.lit(0.0)
    for i in range(k):
        shape, rate, e = F.col(f"shape{i}"), F.col(f"rate{i}"), F.col(f"e{i}")
        term = term + (
            F.lit(alpha * math.log(alpha * beta) - math.lgamma(alpha))
            + (alpha - 1) * F.log(f"g{i}") - alpha * beta * e
            + shape - F.log(rate) + log_gamma(shape) + (1 - shape) * digamma(shape)
        )
    return float(factor.agg(F.sum(term)).first()[0])


class Model:
    """Fitted factors: ``rows`` and ``cols`` with shape*, rate*, g*, e* columns."""

    def __init__(self, rows, cols, row_keys, col_keys, k, alpha, row_beta, col_beta, history):
        self.rows, self.cols = rows, cols
        self.row_keys, self.col_keys = row_keys, col_keys
        self.k, self.alpha, self.row_beta, self.col_beta = k, alpha, row_beta, col_beta
        self.history = history
        # Whether the stopping rule was met; None if none was set or the model was read back.
        self.converged: bool | None = None

    def _long(self, factor: DataFrame, keys: list[str], value: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(i).alias("motif"), F.col(f"g{i}").alias(value)) for i in range(self.k)])
        return factor.select(*keys, F.inline(entries))

    def row_loadings(self) -> DataFrame:
        """Geometric expectations of the row mode: (row keys, motif, loading)."""
        return self._long(self.rows, self.row_keys, "loading")

    def column_factors(self) -> DataFrame:
        """Geometric expectations of the column mode: (column keys, motif, factor)."""
        return self._long(self.cols, self.col_keys, "factor")


def fit(
    matrix: DataFrame, row_dim: DataFrame, col_dim: DataFrame, n_components: int = 15, max_iter: int = 300,
    tol: float | None = 1e-4, alpha: float = ALPHA, seed: int = 0,
    row_keys: tuple[str, ...] = ("sample_id", "region_id"), col_keys: tuple[str, ...] = ("lri_idx",),
    row_start: Callable[[int], Column] | None = None, col_start: Callable[[int], Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Model:
    """Fit by alternating half steps; stop when the bound gains less than ``tol`` (relative).

    The counts are stored once, partitioned by row, and are not exchanged again: a row step stays
    within their partitions and a column step exchanges sums. Each new factor table is a reliable
    checkpoint that replaces the last one, so lineage stays one step long and one table of each
    mode is kept. The data term of the bound comes out of the row step's own join; it describes
    the state before that step.
    """
    k = n_components
    row_keys, col_keys = list(row_keys), list(col_keys)
    row_start = row_start or hash_start(row_keys, 2 * seed)
    col_start = col_start or hash_start(col_keys, 2 * seed + 1)
    nnz = cut_lineage(matrix.select(*row_keys, *col_keys, "value").repartition(*row_keys), keep_layout=True)
    row_dim, col_dim = cut_lineage(row_dim.select(*row_keys)), cut_lineage(col_dim.select(*col_keys))
    # sum of log(y!) is constant in the parameters.
    constant = float(nnz.agg(F.sum(log_gamma(F.col("value") + 1.0))).first()[0] or 0.0)
    rows, cols = _start(row_dim, row_keys, k, row_start), _start(col_dim, col_keys, k, col_start)
    row_sums, col_sums = _sums(rows, k), _sums(cols, k)
    history: list[tuple[int, float, float | None]] = []
    pending = None
    for step in range(max_iter):
        args = (row_keys, col_keys)
        last_rows, last_cols = rows, cols
        rows = cut_lineage(_half_step(nnz, rows, cols, row_dim, row_keys, *args, col_sums, row_sums["beta"], alpha, k, broadcast_rows))
        if step:
            forget(last_rows)
        if pending is not None:
            bound = float(rows.agg(F.sum("fit")).first()[0]) + pending
            delta = None if not history else (bound - history[-1][1]) / abs(history[-1][1])
            history.append((step, bound, delta))
            if tol is not None and delta is not None and delta < tol:
                row_sums = _sums(rows, k)
                break
        used_row_beta = row_sums["beta"]
        row_sums = _sums(rows, k)
        cols = cut_lineage(_half_step(nnz, rows, cols, col_dim, col_keys, *args, row_sums, col_sums["beta"], alpha, k, broadcast_rows))
        if step:
            forget(last_cols)
        used_col_beta = col_sums["beta"]
        col_sums = _sums(cols, k)
        if tol is not None:
            overlap = sum(a * b for a, b in zip(row_sums["e"], col_sums["e"]))
            pending = (
                -overlap - constant + _prior_terms(rows, used_row_beta, alpha, k) + _prior_terms(cols, used_col_beta, alpha, k)
            )
    model = Model(rows.drop("fit"), cols.drop("fit"), row_keys, col_keys, k, alpha, row_sums["beta"], col_sums["beta"], history)
    if tol is not None:
        model.converged = bool(history) and history[-1][2] is not None and history[-1][2] < tol
    return model


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    z, out = x + 8.0, np.zeros_like(x)
    for i in range(8):
        out -= np.log(x + i)
    inv = 1 / z
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return out + (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series


def _priors(shape: np.ndarray, rate: np.ndarray, alpha: float, beta: float) -> float:
    """Prior and entropy part of the bound of factors with Gamma(shape, rate) posteriors."""
    digammas = _digamma(shape)
    log_g, e = digammas - np.log(rate), shape / rate
    return float((
        alpha * math.log(alpha * beta) - math.lgamma(alpha) + (alpha - 1) * log_g - alpha * beta * e
        + shape - np.log(rate) + _log_gamma(shape) + (1 - shape) * digammas
    ).sum())


def _shared_out(g: np.ndarray, v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each count shared out over the components, and its intensity."""
    a = g * v
    total = a.sum(1)
    return a * (y / total)[:, None], total


def _packed(batches):
    """Rows with their counts as blocks of up to BLOCK_NONZEROS nonzeros, each one an Arrow stream."""
    for batch in batches:
        ends = np.append(0, np.cumsum(pc.list_value_length(batch["columns"]).to_numpy(zero_copy_only=False)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_NONZEROS, "right")) - 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])
            lo = hi


def _unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _pass(v: np.ndarray, rate: np.ndarray, alpha: float, beta: float):
    """Update the rows of a block and add up, with the new rows, what the columns get from them."""
    k = v.shape[1]

    def run(held):
        block, g = held[:2]
        part = _unpacked(block)
        sizes = pc.list_value_length(part["columns"]).to_numpy(zero_copy_only=False)
        j, y = (part[c].flatten().to_numpy(zero_copy_only=False) for c in ("columns", "counts"))
        if g is None:
            g = part["g"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        row, own = np.repeat(np.arange(len(sizes)), sizes), v[j]
        share, total = _shared_out(g[row], own, y)
        shape = alpha + np.stack([np.bincount(row, share[:, c], len(sizes)) for c in range(k)], axis=1)
        g = np.exp(_digamma(shape)) / rate
        share, _ = _shared_out(g[row], own, y)
        some, at = np.unique(j, return_inverse=True)
        gained = np.stack([np.bincount(at, share[:, c], len(some)) for c in range(k)], axis=1)
        totals = np.array([*(shape / rate).sum(0), (y * np.log(total)).sum(), _priors(shape, rate, alpha, beta)])
        return block, g, shape, some, gained, totals

    return run


def _by_chunk(n: int):
    """What the columns got from a block, by chunks of CHUNK columns, and its totals under -1."""

    def run(held):
        some, gained, totals = held[3:]
        yield -1, totals
        for c in np.unique(some // CHUNK):
            here = some // CHUNK == c
            out = np.zeros((min(CHUNK, n - int(c) * CHUNK), gained.shape[1]))
            out[some[here] - c * CHUNK] = gained[here]
            yield int(c), out

    return run


def _drop_stored(rdd: RDD) -> None:
    """Delete the files of an RDD's checkpoint."""
    file = rdd.getCheckpointFile()
    if file:
        path = rdd.ctx._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(path, True)


def fit_blocked(
    matrix: DataFrame, row_dim: DataFrame, col_dim: DataFrame, n_components: int = 15, max_iter: int = 300,
    tol: float | None = 1e-4, alpha: float = ALPHA, seed: int = 0,
    row_keys: tuple[str, ...] = ("sample_id", "region_id"), col_keys: tuple[str, ...] = ("lri_idx",),
    row_start: Callable[[int], Column] | None = None, col_start: Callable[[int], Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Model:
    """``fit`` with one job an iteration, for columns proven to be at most ``broadcast_rows``.

    A row's counts are one pair of arrays; rows are packed into blocks once, and each block keeps its
    rows' state. A job updates all blocks in array steps, adds up in the same pass what every column
    gets from the new rows, and reduces those sums by chunks of columns. No plan is made in the loop.
    Blocks are persisted, and reliably stored every STORE_EVERY iterations, so that a lost executor
    costs so many at most. More columns than that go to ``fit``.
    """
    k = n_components
    row_keys, col_keys = list(row_keys), list(col_keys)
    spark = matrix.sparkSession
    col_start = col_start or hash_start(col_keys, 2 * seed + 1)
    row_start = row_start or hash_start(row_keys, 2 * seed)
    starts = _start(col_dim.select(*col_keys), col_keys, k, col_start)
    local = local_copy(starts.orderBy(*col_keys), broadcast_rows)
    if local is starts or local.count() > broadcast_rows:
        return fit(matrix, row_dim, col_dim, k, max_iter, tol, alpha, seed, tuple(row_keys), tuple(col_keys), row_start, col_start, broadcast_rows)
    columns = local.toPandas()
    v = columns[_names("g", k)].to_numpy(float)
    numbers = spark.createDataFrame(columns[col_keys].assign(_j=np.arange(len(columns), dtype=np.int32)), local.select(*col_keys).withColumn("_j", F.lit(0)).schema)
    entries = matrix.join(F.broadcast(numbers), col_keys).groupBy(*row_keys).agg(F.collect_list(F.struct("_j", F.col("value").cast("double").alias("y"))).alias("x"))
    starting = row_dim.select(*row_keys, F.array(*[row_start(i) for i in range(k)]).alias("g"))
    listed = cut_lineage(
        starting.join(entries, row_keys, "left")
        .select(*row_keys, "g", F.coalesce(F.col("x._j"), F.expr("CAST(array() AS array<int>)")).alias("columns"), F.coalesce(F.col("x.y"), F.expr("CAST(array() AS array<double>)")).alias("counts"))
    )
    n_rows, nonzeros, constant, *row_e = listed.agg(
        F.count("*"), F.sum(F.size("counts")), F.sum(F.aggregate("counts", F.lit(0.0), lambda s, y: s + log_gamma(y + 1.0))), *[F.sum(F.col("g")[i]) for i in range(k)],
    ).first()
    constant, row_e = float(constant or 0.0), np.array(row_e, float)
    row_beta, col_e = n_rows * k / row_e.sum(), v.sum(0)
    col_beta = len(v) * k / col_e.sum()
    sc = spark.sparkContext
    parts = max(1, min(sc.defaultParallelism, -(-(nonzeros or 0) // TASK_NONZEROS[0])), -(-(nonzeros or 0) // TASK_NONZEROS[1]))
    blocks = listed.repartition(parts, *row_keys).mapInArrow(_packed, "block binary").rdd.map(lambda r: (bytes(r.block), None))
    shape_c = rate_c = None
    history: list[tuple[int, float, float | None]] = []
    pending = stored = None
    for step in range(max_iter):
        rate = alpha * row_beta + col_e
        last, blocks = blocks, blocks.map(_pass(v, rate, alpha, row_beta)).persist(StorageLevel.MEMORY_AND_DISK)
        keep = step % STORE_EVERY == 0
        if keep:
            blocks.checkpoint()
        sums = blocks.flatMap(_by_chunk(len(v))).reduceByKey(np.add, min(parts, len(v) // CHUNK + 1)).collectAsMap()
        if step:
            last.unpersist()
        if keep:
            if stored is not None:
                _drop_stored(stored)
            stored = blocks
        totals, rows_rate = sums.pop(-1), rate
        if pending is not None:
            bound = totals[k] + pending
            delta = None if not history else (bound - history[-1][1]) / abs(history[-1][1])
            history.append((step, float(bound), None if delta is None else float(delta)))
            if tol is not None and delta is not None and delta < tol:
                row_beta = n_rows * k / totals[:k].sum()
                break
        row_priors, row_e = totals[k + 1], totals[:k]
        row_beta = n_rows * k / row_e.sum()
        gained = np.zeros_like(v)
        for c, own in sums.items():
            gained[c * CHUNK:c * CHUNK + len(own)] = own
        shape_c, rate_c = alpha + gained, alpha * col_beta + row_e
        v, col_e = np.exp(_digamma(shape_c)) / rate_c, (shape_c / rate_c).sum(0)
        if tol is not None:
            pending = -float(row_e @ col_e) - constant + row_priors + _priors(shape_c, rate_c, alpha, col_beta)
        col_beta = len(v) * k / col_e.sum()

    def rows_of(batches):
        for batch in batches:
            for block, shape in zip(batch["block"].to_pylist(), batch["shape"].to_pylist()):
                part = _unpacked(block)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in row_keys], _vectors(np.frombuffer(shape).reshape(-1, k))], [*row_keys, "shape"])

    key_types = ", ".join(f"{c} {t}" for c, t in row_dim.select(*row_keys).dtypes)
    pairs = spark.createDataFrame(blocks.map(lambda held: (held[0], held[2].tobytes())), "block binary, shape binary")
    rows = cut_lineage(pairs.mapInArrow(rows_of, f"{key_types}, shape array<double>"))
    blocks.unpersist()
    _drop_stored(stored)
    forget(listed)
    row_table = rows.select(
        *row_keys, *[F.col("shape")[i].alias(f"shape{i}") for i in range(k)], *[F.lit(float(rows_rate[i])).alias(f"rate{i}") for i in range(k)],
    ).select(
        "*", *[(F.exp(digamma(F.col(f"shape{i}"))) / F.col(f"rate{i}")).alias(f"g{i}") for i in range(k)],
        *[(F.col(f"shape{i}") / F.col(f"rate{i}")).alias(f"e{i}") for i in range(k)],
    )
    values = {c: columns[c] for c in col_keys}
    for name, table in (("shape", shape_c), ("rate", np.broadcast_to(rate_c, v.shape)), ("g", v), ("e", shape_c / rate_c)):
        values |= {f"{name}{i}": table[:, i] for i in range(k)}
    kinds = ", ".join([*(f"{c} {t}" for c, t in col_dim.select(*col_keys).dtypes), *(f"{n}{i} double" for n in ("shape", "rate", "g", "e") for i in range(k))])
    model = Model(row_table, spark.createDataFrame(pd.DataFrame(values), kinds), row_keys, col_keys, k, alpha, row_beta, col_beta, history)
    if tol is not None:
        model.converged = bool(history) and history[-1][2] is not None and history[-1][2] < tol
    return model


def history_table(model: Model, spark) -> DataFrame:
    return spark.createDataFrame(model.history, "iteration int, elbo double, delta double")


def _project_batch(y: np.ndarray, v: np.ndarray, sizes: np.ndarray, alpha: float, rate: np.ndarray, max_iter: int, tol: float, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Row updates of many cells at once, columns fixed: ``y`` and ``v`` list the counts and
    column factors of all cells one after another, ``sizes`` says how many each cell has.
    Returns the loadings and which cells stopped by themselves."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    g = np.full((len(sizes), v.shape[1]), start)
    # Cells stop on their own, so a result does not depend on who shares the batch.
    live = np.ones(len(sizes), dtype=bool)
    for _ in range(max_iter):
        a = np.repeat(g, sizes, axis=0) * v
        share = a * (y / a.sum(1))[:, None]
        shape = alpha + np.add.reduceat(share, first, axis=0)
        new = np.exp(_digamma(shape)) / rate
        moved = np.abs(new - g).max(1) > tol * np.maximum(1e-300, np.abs(g).max(1))
        g = np.where(live[:, None], new, g)
        live &= moved
        if not live.any():
            break
    return g, ~live


def _digamma(x: np.ndarray) -> np.ndarray:
    z = x + SHIFT
    inv2 = 1 / (z * z)
    series = np.zeros_like(z)
    for c in reversed(DIGAMMA_SERIES):
        series = series * inv2 + c
    out = np.log(z) - 0.5 / z + inv2 * series
    for i in range(SHIFT):
        out -= 1 / (x + i)
    return out


def project(
    matrix: DataFrame, model: Model, cells: DataFrame, max_iter: int = 200, tol: float = 1e-10, start: float = 1.0,
    broadcast_rows: int = BROADCAST_ROWS, flag: bool = False,
) -> DataFrame:
    """(sample_id, cell_id, motif, loading) of every cell, with the column factors fixed.

    With ``flag`` a column ``converged`` tells whether the cell stopped within ``max_iter`` passes.

    Rows are independent given the columns: thin counts are shuffled once by cell (not at all if the
    matrix comes as one list ``found`` of (column, value) per cell), and each cell's list (at most one
    entry per column) is updated in Arrow batches. Column factors
    proven small travel to the tasks as one broadcast matrix; otherwise they are joined to
    the counts first. Cells without counts keep the prior shape. ``tol`` is a relative
    change at which a cell stops early.
    """
    spark = matrix.sparkSession
    k, alpha, beta = model.k, model.alpha, model.row_beta
    col_sum = np.array(_sums(model.cols, k)["e"])
    rate = alpha * beta + col_sum
    key, col_key = ["sample_id", "region_id"], model.col_keys
    factors = model.cols.select(*col_key, F.array(*[F.col(f"g{i}") for i in range(k)]).alias("cg"))
    local = local_copy(factors, broadcast_rows) if len(col_key) == 1 else factors
    listed = "found" in matrix.columns
    if listed and local is factors:
        matrix, listed = matrix.select(*key, F.inline("found")), False
    thin_counts = None if listed else matrix.select(*key, *col_key, "value").repartition(*key)
    shared = None
    if local is not factors:
        table = local.toPandas().sort_values(col_key[0])
        shared = spark.sparkContext.broadcast(
            (table[col_key[0]].to_numpy(), np.array(table["cg"].tolist(), dtype=float).reshape(-1, k))
        )
        entries = matrix.select(*key, F.col("found").alias("entries")) if listed else thin_counts.groupBy(*key).agg(
            F.collect_list(F.struct("value", *col_key)).alias("entries")
        )
        lists = entries.select(*key, F.col("entries.value").alias("values"), F.col(f"entries.{col_key[0]}").alias("extra"))
    else:
        entries = thin_counts.join(factors, col_key).groupBy(*key).agg(F.collect_list(F.struct("value", "cg")).alias("entries"))
        lists = entries.select(*key, F.col("entries.value").alias("values"), F.flatten("entries.cg").alias("extra"))

    def pieces(batches):
        # A batch holds a fixed number of cells; bound the nonzeros worked on at once too.
        for batch in batches:
            ends = np.cumsum([len(c) for c in batch["values"]])
            group = (ends - 1) // MAX_NONZEROS if len(ends) else ends
            for g in np.unique(group):
                yield batch[group == g].reset_index(drop=True)

    def update(batches):
        for batch in pieces(batches):
            sizes = np.array([len(c) for c in batch["values"]])
            extra = np.concatenate(batch["extra"].to_list())
            y = np.concatenate(batch["values"].to_list()).astype(float)
            if shared is not None:
                columns, values = shared.value
                at = np.minimum(np.searchsorted(columns, extra), len(columns) - 1)
                # Columns the model does not have count for nothing.
                v, y = values[at], np.where(columns[at] == extra, y, 0.0)
            else:
                v = extra.astype(float).reshape(-1, k)
            g, stopped = _project_batch(y, v, sizes, alpha, rate, max_iter, tol, start)
            out = batch[key].copy()
            for i in range(k):
                out[f"g{i}"] = g[:, i]
            out["stopped"] = stopped
            yield out

    fields = ", ".join(f"g{i} double" for i in range(k))
    found = lists.mapInPandas(update, f"sample_id string, region_id bigint, {fields}, stopped boolean")
    prior = np.exp(_digamma(np.full(k, alpha))) / rate
    all_cells = cells.select("sample_id", F.col("cell_id").alias("region_id")).join(found, key, "left")
    entries = F.array(*[
        F.struct(F.lit(i).alias("motif"), F.coalesce(f"g{i}", F.lit(float(prior[i]))).alias("loading")) for i in range(k)
    ])
    done = [F.coalesce("stopped", F.lit(True)).alias("converged")] if flag else []
    return all_cells.select("sample_id", F.col("region_id").alias("cell_id"), *done, F.inline(entries))


def rescale(w: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scale every motif to a greatest loading of 1; the product stays the same."""
    scales = w.groupBy("motif").agg(F.max("loading").alias("w_max")).withColumn(
        "w_max", F.when(F.col("w_max") > 0, F.col("w_max")).otherwise(F.lit(1.0))
    )
    b = small_table(scales)
    return (
        w.join(b, "motif").withColumn("loading", F.col("loading") / F.col("w_max")).drop("w_max"),
        v.join(b, "motif").withColumn("factor", F.col("factor") * F.col("w_max")).drop("w_max"),
        scales,
    )


def reconstruction_error(w: DataFrame, v: DataFrame, w2: DataFrame, v2: DataFrame, scales: DataFrame, row_keys: list[str]) -> DataFrame:
    """(n_loadings, n_factors, rel_err): how far rescaling moved the product, over all entries.

    Every loading is compared with its rescaled one times the motif's scale, and every rescaled
    factor with the factor times the scale. All are positive, so the two greatest relative
    differences together bound that of every entry of the product, which is never formed.
    """
    b = small_table(scales)

    def compared(x: DataFrame, y: DataFrame, keys: list[str], value: str, back: Column) -> DataFrame:
        both = x.select(*keys, "motif", F.col(value).alias("a")).join(y.select(*keys, "motif", F.col(value).alias("b")), [*keys, "motif"])
        gap = F.abs(back - F.col("a") * F.when(F.lit(value == "factor"), F.col("w_max")).otherwise(1.0))
        size = F.greatest(F.abs("a") * F.when(F.lit(value == "factor"), F.col("w_max")).otherwise(1.0), F.lit(1e-300))
        return both.join(b, "motif").agg(F.count("*").alias("n"), F.coalesce(F.max(gap / size), F.lit(0.0)).alias("err"))

    rows = compared(w, w2, row_keys, "loading", F.col("b") * F.col("w_max")).first()
    cols = compared(v, v2, ["lri_idx"], "factor", F.col("b")).first()
    spark = w.sparkSession
    return spark.createDataFrame([(rows["n"], cols["n"], rows["err"] + cols["err"])], "n_loadings long, n_factors long, rel_err double")


def top_motifs(w: DataFrame, top_k: int = 10) -> DataFrame:
    totals = w.groupBy("motif").agg(F.sum("loading").alias("activity"))
    grand = F.sum("activity").over(Window.partitionBy())
    return totals.withColumn("fraction", F.col("activity") / grand).orderBy(F.desc("activity"), "motif").limit(top_k)


def thin_probabilities(matrix: DataFrame, n_regions: DataFrame, quantile: float) -> DataFrame:
    """(lri_idx, mean, p): keep-probability bringing frequent columns down to the quantile."""
    means = with_each(matrix.groupBy("lri_idx").agg(F.sum("value").alias("_s")), n_regions).select(
        "lri_idx", (F.col("_s") / F.col("n_regions")).alias("mean")
    )
    cut = means.agg(F.percentile("mean", F.lit(int(quantile * 100) / 100.0)).alias("cut"))
    return with_each(means, cut).select("lri_idx", "mean", F.least(F.lit(1.0), F.col("cut") / F.col("mean")).alias("p"))


# Trials whose number of successes is drawn from one uniform number.
TRIALS = 256


def _binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Binomial(n, p) draws, each a function of its own key, in array steps over all entries.

    n is cut into runs of TRIALS; the successes of a run come from inverting the distribution at a
    uniform number made from the key and the number of the run.
    """
    out = np.where(p >= 1, n, 0).astype(np.int64)
    rest = np.where((p >= 1) | (p <= 0), 0, n)
    # Fewer successes than failures are drawn, so that no start of the recurrence underflows.
    q = np.where(p > 0.5, 1 - p, p)
    run = 0
    while (live := np.flatnonzero(rest > 0)).size:
        m, r, k = np.minimum(rest[live], TRIALS), q[live], key[live] + np.uint64((run + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            k = (k ^ (k >> np.uint64(shift))) * np.uint64(factor)
        u = ((k ^ (k >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
        mass = np.exp(m * np.log1p(-r))
        below, found = mass.copy(), np.zeros(len(m), np.int64)
        for i in range(int(m.max())):
            go = (u >= below) & (found == i) & (i < m)
            if not go.any():
                break
            found[go] = i + 1
            mass = mass * np.maximum(m - i, 0) / (i + 1) * (r / (1 - r))
            below += mass
        out[live] += np.where(p[live] > 0.5, m - found, found)
        rest[live] -= m
        run += 1
    return out


def thin(matrix: DataFrame, probabilities: DataFrame, row_keys: list[str], seed: int = 0) -> DataFrame:
    """Keep Binomial(value, p) of every count; draws depend only on the seed and the key."""
    def draw(value: pd.Series, p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_binomial(value.to_numpy(np.int64), p.to_numpy(float), h.to_numpy(np.int64).astype(np.uint64)))

    key = F.pmod(F.xxhash64(*row_keys, "lri_idx", F.lit(seed)), F.lit(2**62))
    kept = matrix.join(small_table(probabilities.select("lri_idx", "p")), "lri_idx")
    drawn = kept.withColumn("value", F.pandas_udf(draw, "long")("value", "p", key))
    return drawn.where("value > 0").select(*row_keys, "lri_idx", "value")
