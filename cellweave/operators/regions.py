"""Regions of cells: grid patches, square neighborhoods, and sums over squares.

A region is only a set of key columns. Counting (see ``interactions``) is the same code
for both kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import squares
from cellweave.session import cut_lineage, fine_shuffles, small_table

# A grid bucket with more distinct positions than this is split into a quadtree.
HOT_BUCKET = 65_536
# Buckets along the side of a tile, whose squares are summed together.
TILE = 2
# The same for tiles of single cells, which are worked out part by part: 2.25 copies of each cell.
CELL_TILE = 4
MAX_LEVEL = 30


def sample_extents(cells: DataFrame, size: float) -> DataFrame:
    """Grid origin and edge count per sample."""
    edges = lambda c: F.ceil((F.max(c) + F.lit(size) - F.min(c)) / size)
    return cells.groupBy("sample_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        edges("x").alias("nx"), edges("y").alias("ny"),
    )


def _bin(v: Column, origin: Column, size: float) -> Column:
    """Index of the last edge ``origin + i*size`` not above ``v`` (rounding corrected)."""
    i = F.floor((v - origin) / size)
    return (
        F.when(v >= origin + (i + 1) * F.lit(size), i + 1)
        .when(v < origin + i * F.lit(size), i - 1)
        .otherwise(i)
    )


def assign_patches(cells: DataFrame, size: float = 50.0) -> DataFrame:
    """Add grid indexes and ``patch_id``; null patch for cells on the outermost edge.

    No shuffle of the cells: only one small row per sample is joined in.
    """
    ext = small_table(sample_extents(cells, size))
    placed = (
        cells.join(ext, "sample_id")
        .withColumn("xi", _bin(F.col("x"), F.col("x0"), size))
        .withColumn("yi", _bin(F.col("y"), F.col("y0"), size))
    )
    valid = (F.col("xi") < F.col("nx") - 1) & (F.col("yi") < F.col("ny") - 1)
    return placed.withColumn("patch_id", F.when(valid, F.col("xi") * F.col("ny") + F.col("yi")))


def patch_table(assigned: DataFrame, size: float = 50.0) -> DataFrame:
    """One row per occupied valid patch with its cell count, box and dense index."""
    per_patch = (
        assigned.where(F.col("patch_id").isNotNull())
        .groupBy("sample_id", "patch_id", "xi", "yi", "x0", "y0")
        .agg(F.count("*").alias("n_cells"))
    )
    mid = lambda o, i: (F.col(o) + F.col(i) * F.lit(size) + (F.col(o) + (F.col(i) + 1) * F.lit(size))) / 2
    boxed = per_patch.withColumn("x_center", mid("x0", "xi")).withColumn("y_center", mid("y0", "yi"))
    half = size / 2
    return dense_index(boxed).select(
        "sample_id", "patch_id", "xi", "yi", "patch_idx", "global_patch_idx",
        "x_center", "y_center",
        (F.col("x_center") - half).alias("x_min"), (F.col("x_center") + half).alias("x_max"),
        (F.col("y_center") - half).alias("y_min"), (F.col("y_center") + half).alias("y_max"),
        "n_cells",
    )


def dense_index(patches: DataFrame) -> DataFrame:
    """Rank of a patch within its sample, and over all samples.

    A sample may own a third of all patches, so it is never one window: patches rank
    inside their grid column, and running totals over columns and samples are added.
    """
    within = Window.partitionBy("sample_id", "xi").orderBy("yi")
    ranked = patches.withColumn("_r", F.row_number().over(within) - 1)
    columns = patches.groupBy("sample_id", "xi").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("sample_id").orderBy("xi").rowsBetween(Window.unboundedPreceding, -1)
    columns = columns.select("sample_id", "xi", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    samples = patches.groupBy("sample_id").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1)
    samples = samples.select("sample_id", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    return (
        ranked.join(columns, ["sample_id", "xi"]).join(samples, "sample_id")
        .withColumn("patch_idx", F.col("_r") + F.col("_c"))
        .withColumn("global_patch_idx", F.col("patch_idx") + F.col("_s"))
    )


def patch_index(assigned: DataFrame, size: float = 50.0) -> DataFrame:
    """Every cell with its patch index; -1 where the cell has no valid patch."""
    idx = patch_table(assigned, size).select("sample_id", "patch_id", "patch_idx", "global_patch_idx")
    return assigned.join(idx, ["sample_id", "patch_id"], "left").select(
        "sample_id", "cell_id",
        F.coalesce("patch_idx", F.lit(-1)).alias("patch_idx"),
        F.coalesce("global_patch_idx", F.lit(-1)).alias("global_patch_idx"),
    )


def _bucket(v: Column, half: float) -> Column:
    """Grid bucket, a hair wider than ``half``: a neighbor is never two buckets away."""
    return F.floor(v / F.lit(half * (1 + 1e-9)))


def _around(bucket: Column) -> Column:
    return F.explode(F.array(*[bucket + d for d in (-1, 0, 1)]))


def _in_square(px: str, py: str, cx: str, cy: str, half: float) -> Column:
    return F.col(px).between(F.col(cx) - half, F.col(cx) + half) & F.col(py).between(
        F.col(cy) - half, F.col(cy) + half
    )


def _spread(points: DataFrame, half: float) -> DataFrame:
    """Copy each point into the nine buckets whose centers may reach it."""
    return (
        points.withColumn("bx", _around(_bucket(F.col("px"), half)))
        .withColumn("by", _around(_bucket(F.col("py"), half)))
    )


def neighbor_edges(cells: DataFrame, size: float = 50.0, hot: int = HOT_BUCKET) -> DataFrame:
    """(sample_id, center_id, nbr_id): all cells inside the center's square, itself included.

    The pair list is the result asked for here; sums over neighborhoods use ``square_sums``, which needs
    no pairs. Cells meet tile by tile and pairs leave their tile in lists (``squares.cell_neighbors``):
    only the cells and their copies at the borders of tiles are exchanged.

    Where a bucket holds more than ``hot`` cells, an equi-join on the grid bucket and the exact test take their
    place: dense buckets are then split on both sides by AQE's skew join. That join never broadcasts: the planner
    takes the nine copies of each point for one and would send them all through the driver.
    """
    fine_shuffles(cells.sparkSession)
    half = size / 2
    if not has_dense_bucket(cells, size, hot):
        found = cell_tiles(
            cells.select("sample_id", "cell_id", "x", "y"), size, squares.cell_neighbors(half),
            {"sample_id": "sample_id", "center_id": "cell_id"}, "sample_id string, center_id bigint, found array<bigint>",
        )
        return found.select("sample_id", "center_id", F.explode("found").alias("nbr_id"))
    centers = cells.select(
        "sample_id", F.col("cell_id").alias("center_id"), F.col("x").alias("cx"), F.col("y").alias("cy"),
        _bucket(F.col("x"), half).alias("bx"), _bucket(F.col("y"), half).alias("by"),
    )
    points = _spread(
        cells.select("sample_id", F.col("cell_id").alias("nbr_id"), F.col("x").alias("px"), F.col("y").alias("py")),
        half,
    )
    return (
        centers.hint("merge").join(points, ["sample_id", "bx", "by"])
        .where(_in_square("px", "py", "cx", "cy", half))
        .select("sample_id", "center_id", "nbr_id")
    )


POSITION = ["sample_id", "bx", "by", "cx", "cy"]


def positions(cells: DataFrame, size: float) -> DataFrame:
    """Distinct cell positions with their grid bucket: copies of a position share a region."""
    half = size / 2
    return cells.select(
        "sample_id", _bucket(F.col("x"), half).alias("bx"), _bucket(F.col("y"), half).alias("by"),
        F.col("x").alias("cx"), F.col("y").alias("cy"),
    ).distinct()


def position_ids(cells: DataFrame, size: float) -> tuple[DataFrame, DataFrame | None]:
    """``positions`` with ``center``, the least cell id at each, and (sample_id, center, cell_id) for
    every cell of the positions that several cells share, if there are any."""
    half = size / 2
    placed = cells.select(
        "sample_id", _bucket(F.col("x"), half).alias("bx"), _bucket(F.col("y"), half).alias("by"),
        F.col("x").alias("cx"), F.col("y").alias("cy"), "cell_id",
    )
    grouped = placed.groupBy(*POSITION).agg(F.min("cell_id").alias("center"), F.count("*").alias("n"))
    several = grouped.where("n > 1").select("sample_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "center")
    copies = None if several.isEmpty() else cells.join(several, ["sample_id", "x", "y"]).select("sample_id", "center", "cell_id")
    return grouped.drop("n"), copies


def square_sums(
    centers: DataFrame, weights: DataFrame, size: float, item: list[str], hot: int = HOT_BUCKET, ids: tuple[str, ...] = (),
) -> DataFrame:
    """Sum ``n`` per item over the square around each center position.

    ``centers``: POSITION columns, distinct. ``weights``: (sample_id, x, y, *item, n), one row
    per position and item; every position with a weight is also a center, so density can be
    judged from the centers alone. Result: POSITION + item + n; with ``ids``, columns of the centers
    that tell those of a sample apart, they take the place of the coordinates.

    Buckets of ordinary density are summed tile by tile (``squares``): centers stay at home, points
    are copied to the four tiles that may need them, and a tile costs little more than its points
    times their logarithm, not its pairs. Buckets with more than ``hot`` distinct positions go through
    a quadtree whose fully covered nodes contribute one pre-aggregated row each.
    """
    half = size / 2
    key = [*POSITION[:3], *ids] if ids else POSITION
    crowded = centers.groupBy("sample_id", "bx", "by").count().where(F.col("count") > hot).select("sample_id", "bx", "by")
    has_hot = not crowded.isEmpty()
    if has_hot:
        # Every level of the tree reads the weights.
        weights = cut_lineage(weights)
    cold_centers, cold_weights = centers, weights
    if has_hot:
        hot_buckets = small_table(cut_lineage(crowded))
        cold_centers = centers.join(hot_buckets, ["sample_id", "bx", "by"], "left_anti")
        cold_weights = (
            weights.withColumn("bx", _bucket(F.col("x"), half)).withColumn("by", _bucket(F.col("y"), half))
            .join(hot_buckets, ["sample_id", "bx", "by"], "left_anti").drop("bx", "by")
        )
    entry = ", ".join(f"{c}:{t}" for c, t in weights.select(*item).dtypes + [("n", "bigint")])
    found = tile_lists(cold_centers, cold_weights, size, item, squares.item_lists(item), f"array<struct<{entry}>>")
    sums = found.select(*key, F.inline("found"))
    if not has_hot:
        return sums
    dense = _quadtree_sums(centers, weights, hot_buckets, half, item, hot, [*POSITION, *ids], key)
    return sums.unionByName(dense).groupBy(*key, *item).agg(F.sum("n").alias("n"))


def tile_lists(centers: DataFrame, weights: DataFrame, size: float, item: list[str], finish, found: str) -> DataFrame:
    """The columns of ``centers`` and ``found`` (of that type), which ``finish`` makes of a tile's sums."""
    half = size / 2
    fine_shuffles(centers.sparkSession)
    tile = ["sample_id", "tx", "ty"]
    points = weights.groupBy("sample_id", F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.collect_list(F.struct(*item, "n")).alias("items"))

    def reach(c: str) -> Column:
        bucket = _bucket(F.col(c), half)
        return F.explode(F.array_distinct(F.array(F.floor((bucket - 1) / TILE), F.floor((bucket + 1) / TILE))))

    points = points.withColumn("tx", reach("cx")).withColumn("ty", reach("cy"))
    homes = centers.withColumn("tx", F.floor(F.col("bx") / TILE)).withColumn("ty", F.floor(F.col("by") / TILE))
    schema = ", ".join(f"{c} {t}" for c, t in centers.dtypes)
    run = squares.tile_function(half, item, centers.columns, finish)
    return homes.unionByName(points, allowMissingColumns=True).groupBy(*tile).applyInArrow(run, f"{schema}, found {found}")


def has_dense_bucket(cells: DataFrame, size: float, hot: int = HOT_BUCKET) -> bool:
    """Whether a grid bucket holds more than ``hot`` cells."""
    buckets = cells.groupBy("sample_id", _bucket(F.col("x"), size / 2).alias("bx"), _bucket(F.col("y"), size / 2).alias("by")).count()
    return not buckets.where(F.col("count") > hot).isEmpty()


def cell_tiles(cells: DataFrame, size: float, part, columns: dict[str, str], schema: str) -> DataFrame:
    """What ``part`` makes of the cells of each part of a tile and those within reach (``squares.parts_function``).

    Each cell is copied to the tiles whose squares may reach it; nothing else is exchanged. ``cells``:
    (sample_id, x, y, ...); cells without a position have no square and are in none.
    """
    half = size / 2
    fine_shuffles(cells.sparkSession)

    def reach(c: str) -> Column:
        bucket = _bucket(F.col(c), half)
        return F.explode(F.array_distinct(F.array(F.floor((bucket - 1) / CELL_TILE), F.floor((bucket + 1) / CELL_TILE))))

    placed = cells.where("x IS NOT NULL AND y IS NOT NULL").withColumn("tx", reach("x")).withColumn("ty", reach("y"))
    return placed.groupBy("sample_id", "tx", "ty").applyInArrow(squares.parts_function(half, CELL_TILE, part, columns), schema)


def is_crowded(centers: DataFrame, hot: int = HOT_BUCKET) -> bool:
    """Whether a grid bucket holds more than ``hot`` positions."""
    return not centers.groupBy("sample_id", "bx", "by").count().where(F.col("count") > hot).isEmpty()


def _quadtree_sums(
    centers: DataFrame, weights: DataFrame, hot_buckets: DataFrame, half: float, item: list[str], leaf: int, own: list[str],
    key: list[str],
) -> DataFrame:
    """Contributions of every (center, bucket) pair in which either side is a hot bucket.

    A frontier of (center, node) pairs descends level by level (a node many centers look at
    is one row on its side of the join, so AQE can split the frontier). A node lying inside the
    square adds its aggregated items; one that overlaps it partly is opened if it holds
    more than ``leaf`` positions and read point by point otherwise. Nodes are tested by
    the true bounding box of their points, with the same comparison as single points.
    """
    width = half * (1 + 1e-9)
    root = ["sample_id", "tx", "ty"]
    node = [*root, "qx", "qy"]
    pts = weights.select(
        "sample_id", F.col("x").alias("px"), F.col("y").alias("py"),
        _bucket(F.col("x"), half).alias("tx"), _bucket(F.col("y"), half).alias("ty"), *item, "n",
    )
    hot_key = hot_buckets.select("sample_id", F.col("bx").alias("hx"), F.col("by").alias("hy"), F.lit(True).alias("is_hot"))
    around = (
        centers.withColumn("tx", _around(F.col("bx")))
        .withColumn("ty", _around(F.col("by")))
    )
    home = around.join(
        hot_key.select("sample_id", F.col("hx").alias("bx"), F.col("hy").alias("by"), F.col("is_hot").alias("home_hot")),
        ["sample_id", "bx", "by"], "left",
    )
    pairs = home.join(
        hot_key.select("sample_id", F.col("hx").alias("tx"), F.col("hy").alias("ty"), F.col("is_hot").alias("target_hot")),
        root, "left",
    ).where("home_hot OR target_hot").select(*own, "tx", "ty")
    # Only buckets next to a hot one can occur in these pairs.
    pts = pts.join(pairs.select(*root).distinct(), root, "left_semi")

    def cell_at(level: int, v: str, t: str) -> Column:
        inner = F.floor((F.col(v) - F.col(t) * F.lit(width)) * F.lit(2.0**level / width))
        return F.greatest(F.lit(0), F.least(F.lit(2**level - 1), inner))

    parts: list[DataFrame] = []
    frontier = pairs
    level = 0
    while True:
        at_level = pts.withColumn("qx", cell_at(level, "px", "tx")).withColumn("qy", cell_at(level, "py", "ty"))
        boxes = (
            at_level.select(*node, "px", "py").distinct().groupBy(*node)
            .agg(
                F.count("*").alias("n_pos"), F.min("px").alias("x_lo"), F.max("px").alias("x_hi"),
                F.min("py").alias("y_lo"), F.max("py").alias("y_hi"),
            )
        )
        if level == 0:
            met = frontier.join(boxes, root)
        else:
            up = boxes.withColumn("ux", F.floor(F.col("qx") / 2)).withColumn("uy", F.floor(F.col("qy") / 2))
            met = frontier.join(up, [*root, "ux", "uy"]).drop("ux", "uy")
        touches = (
            (F.col("x_hi") >= F.col("cx") - half) & (F.col("x_lo") <= F.col("cx") + half)
            & (F.col("y_hi") >= F.col("cy") - half) & (F.col("y_lo") <= F.col("cy") + half)
        )
        inside = (
            (F.col("x_lo") >= F.col("cx") - half) & (F.col("x_hi") <= F.col("cx") + half)
            & (F.col("y_lo") >= F.col("cy") - half) & (F.col("y_hi") <= F.col("cy") + half)
        )
        open_it = (F.col("n_pos") > leaf) & F.lit(level < MAX_LEVEL)
        met = cut_lineage(
            met.where(touches)
            .withColumn("fate", F.when(inside, "all").when(open_it, "open").otherwise("read"))
            .select(*own, "tx", "ty", "qx", "qy", "fate")
        )
        node_items = at_level.groupBy(*node, *item).agg(F.sum("n").alias("n"))
        parts.append(met.where("fate = 'all'").join(node_items, node).select(*own, *item, "n"))
        parts.append(
            met.where("fate = 'read'").join(at_level, node)
            .where(_in_square("px", "py", "cx", "cy", half)).select(*own, *item, "n")
        )
        frontier = met.where("fate = 'open'").select(
            *own, "tx", "ty", F.col("qx").alias("ux"), F.col("qy").alias("uy")
        )
        level += 1
        if frontier.isEmpty():
            break
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(*key, *item).agg(F.sum("n").alias("n"))


def neighborhood_sizes(cells: DataFrame, size: float = 50.0) -> DataFrame:
    """Cells in each center's square, counted without listing the pairs."""
    here = cells.groupBy("sample_id", "x", "y").agg(F.count("*").alias("n"))
    sums = square_sums(positions(cells, size), here, size, [])
    return cells.join(
        sums.select("sample_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("n").alias("n_neighbors")),
        ["sample_id", "x", "y"],
    ).select("sample_id", "cell_id", "n_neighbors")


def average_neighborhood_size(cells: DataFrame, size: float = 50.0) -> DataFrame:
    """Mean neighborhood size per sample, from position totals only."""
    here = cells.groupBy("sample_id", "x", "y").agg(F.count("*").alias("n"))
    sums = square_sums(positions(cells, size), here, size, [])
    both = sums.select("sample_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("n").alias("nbrs")).join(
        here, ["sample_id", "x", "y"]
    )
    return both.groupBy("sample_id").agg(
        F.sum("n").alias("n_cells"), (F.sum(F.col("n") * F.col("nbrs")) / F.sum("n")).alias("avg_neighborhood_size")
    )


def cells_per_patch(patches: DataFrame, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Summary row and histogram of cells per patch. Exact median: it merges value counts."""
    from cellweave.operators.motifs import histogram

    summary = patches.agg(
        F.count("*").alias("n_patches"), F.sum("n_cells").alias("n_cells"), F.avg("n_cells").alias("mean"),
        F.median("n_cells").alias("median"), F.min("n_cells").alias("min"), F.max("n_cells").alias("max"),
    )
    return summary, histogram(patches, F.col("n_cells"), bins)
