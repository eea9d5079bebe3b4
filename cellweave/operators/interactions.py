"""Region x interaction counts. One builder serves patches and neighborhoods.

Both steps have one shape: join to a small membership table, group, and keep groups that
are complete. Per cell, a gene is a feature of one gene and a pair is a feature of all its
genes (co-expression). Per region, a complex is complete when each of its genes occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.names import lri_name
from cellweave.operators import lrdb, regions, squares
from cellweave.session import fine_shuffles, local_copy, require, small_table, with_each


class PairTables:
    """Small tables derived from the usable pairs, evaluated together in one job.

    Every LR gene and every LR pair has an integer ``item``. ``features`` says which items a
    cell's gene belongs to and how many genes the item needs; ``sides`` says which side of
    which pair an item counts for and how many items that side needs. All tables have at
    most a few rows per gene of a pair; they are broadcast only if proven small.
    """

    def __init__(self, pairs: DataFrame, contact: str = lrdb.CONTACT):
        self.pairs = pairs
        genes = lrdb.pair_genes(pairs)
        by_gene = genes.groupBy("gene").agg(F.collect_set("lr_id").alias("lrs"), F.collect_list(F.struct("lr_id", "side", "n_genes")).alias("roles"))
        # Items 1.. are genes; pair items are negative, so the two never meet.
        coded = by_gene.withColumn("item", F.row_number().over(Window.orderBy("gene")))
        pair_item = F.transform("lrs", lambda lr: -lr - 1)
        needed = genes.groupBy("lr_id").agg(F.countDistinct("gene").alias("need"))
        gene_rows = coded.select(
            "gene", F.lit(None).cast("int").alias("lr_id"), F.lit("gene").alias("side"), "item", F.lit(1).cast("long").alias("need")
        )
        member_rows = coded.select("gene", F.explode(F.arrays_zip(F.col("lrs").alias("lr_id"), pair_item.alias("item"))).alias("m")).select(
            "gene", "m.lr_id", "m.item"
        ).join(needed, "lr_id").select("gene", "lr_id", F.lit("pair").alias("side"), "item", "need")
        side_rows = coded.select("item", F.inline("roles")).select(
            F.lit(None).cast("string").alias("gene"), "lr_id", "side", "item", F.col("n_genes").cast("long").alias("need")
        )
        auto_rows = needed.select(
            F.lit(None).cast("string").alias("gene"), "lr_id", F.lit("A").alias("side"), (-F.col("lr_id") - 1).alias("item"), F.lit(1).cast("long").alias("need")
        )
        rows = gene_rows.unionByName(member_rows).unionByName(side_rows).unionByName(auto_rows)
        local = local_copy(rows)
        self.is_small = local is not rows
        self._hint = F.broadcast if self.is_small else (lambda df: df)
        named = local.where("gene IS NOT NULL")
        self.panel = self._hint(named.where("side = 'gene'").select("gene"))
        self.names = self._hint(named.where("side = 'gene'").select("item", "gene"))
        self.features = self._hint(named.select("gene", "item", "need"))
        self.sides = self._hint(local.where("gene IS NULL").select("item", "lr_id", "side", "need"))
        self.kinds = self._hint(pairs.select("lr_id", (F.col("signaling_type") == contact).alias("is_contact")))


def tables_of(pairs: DataFrame | PairTables) -> PairTables:
    return pairs if isinstance(pairs, PairTables) else PairTables(pairs)


def cell_features(cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables) -> DataFrame:
    """(cells.*, item): expressed LR genes and co-expressed LR pairs of typed cells.

    LR genes are selected before the join to cells. Expression and cells are both facts:
    the join is asked to stay partitioned by cell, and the grouping then needs no shuffle.
    """
    fine_shuffles(cells.sparkSession)
    p = tables_of(pairs)
    hits = expression.where(F.col("count") > 0).join(p.panel, "gene", "left_semi").select("sample_id", "cell_id", "gene")
    typed = cells.where(F.col("cell_type").isNotNull())
    keys = typed.columns
    found = hits.join(typed.hint("merge"), ["sample_id", "cell_id"]).join(p.features, "gene")
    return (
        found.groupBy(*keys, "item").agg(F.count("*").alias("have"), F.first("need").alias("need"))
        .where("have = need").select(*keys, "item")
    )


def region_gene_counts(counts: DataFrame, pairs: DataFrame | PairTables) -> DataFrame:
    """Expressing cells per (region, cell type, gene)."""
    return counts.join(tables_of(pairs).names, "item").drop("item")


def complex_counts(counts: DataFrame, pairs: DataFrame | PairTables, region: list[str]) -> DataFrame:
    """Per region, cell type and pair: side L / R as the least of its gene counts, side A
    as the co-expressing cells. A side with a missing gene has no row."""
    return (
        counts.join(tables_of(pairs).sides, "item")
        .groupBy(*region, "lr_id", "side", "cell_type")
        .agg(F.min("n").alias("n"), F.count("*").alias("have"), F.first("need").alias("need"))
        .where("have = need").drop("have", "need")
    )


def pair_values(counts: DataFrame, pairs: DataFrame | PairTables, region: list[str]) -> DataFrame:
    """(region, lr_id, celltype1, celltype2, mode, value), nonzero rows only.

    Sender and receiver lists per (region, pair) hold at most one entry per cell type.
    """
    p = tables_of(pairs)
    sides = complex_counts(counts, p, region)
    entry = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("cell_type", "n")))
    lists = sides.groupBy(*region, "lr_id").agg(
        entry("L").alias("senders"), entry("R").alias("receivers"), entry("A").alias("auto")
    ).where((F.size("senders") > 0) & (F.size("receivers") > 0))
    crossed = (
        lists.join(p.kinds, "lr_id")
        .withColumn("auto", F.map_from_entries("auto"))
        .select(*region, "lr_id", "is_contact", "auto", "receivers", F.inline("senders").alias("celltype1", "n1"))
        .select(*region, "lr_id", "is_contact", "auto", "celltype1", "n1", F.inline("receivers").alias("celltype2", "n2"))
        .withColumn("same", F.col("celltype1") == F.col("celltype2"))
        .withColumn("a", F.when(F.col("same"), F.coalesce(F.col("auto")[F.col("celltype1")], F.lit(0))).otherwise(F.lit(0)))
    )
    between = F.col("n1") * F.col("n2") - F.col("a")
    value = lambda mode, v: F.struct(F.lit(mode).alias("mode"), v.cast("long").alias("value"))
    split = (
        F.when(F.col("is_contact"), F.array(value("juxtacrine", between)))
        .when(F.col("same"), F.array(value("autocrine", F.col("a")), value("paracrine", between)))
        .otherwise(F.array(value("paracrine", between)))
    )
    return crossed.select(*region, "lr_id", "celltype1", "celltype2", F.inline(split)).where("value <> 0")


def patch_counts(cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables, size: float = 50.0) -> DataFrame:
    """(sample_id, region_id, cell_type, item, n) over grid patches."""
    placed = regions.assign_patches(cells, size).where(F.col("patch_id").isNotNull()).select(
        "sample_id", "cell_id", "cell_type", F.col("patch_id").alias("region_id")
    )
    # Combined on the map side, so a crowded patch shuffles one row per (type, item).
    counts = cell_features(placed, expression, pairs).groupBy(
        "sample_id", "region_id", "cell_type", "item"
    ).agg(F.count("*").alias("n"))
    # From here on everything is grouped inside a region: one exchange serves all of it.
    return counts.repartition("sample_id", "region_id")


def patch_lri(cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables, size: float = 50.0) -> DataFrame:
    """Patch x interaction matrix in long form."""
    p = tables_of(pairs)
    return pair_values(patch_counts(cells, expression, p, size), p, ["sample_id", "region_id"])


def neighborhood_counts(
    cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables, size: float = 50.0, centers: DataFrame | None = None, **kw,
) -> DataFrame:
    """Counts over square neighborhoods, per distinct center position."""
    here = position_features(cells, expression, pairs)
    return regions.square_sums(regions.positions(cells, size) if centers is None else centers, here, size, ["cell_type", "item"], **kw)


def position_features(cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables) -> DataFrame:
    """(sample_id, x, y, cell_type, item, n): cells of each position that have the item."""
    return cell_features(
        cells.select("sample_id", "cell_id", "x", "y", "cell_type"), expression, pairs
    ).groupBy("sample_id", "x", "y", "cell_type", "item").agg(F.count("*").alias("n"))


def to_cells(values: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Rows of positions handed to all cells there, without moving them: ``center`` becomes ``region_id``.

    ``copies`` lists the cells of positions that several cells share; it is broadcast if proven small.
    """
    rest = [c for c in values.columns if c not in ("sample_id", "center")]
    if copies is None:
        return values.select("sample_id", F.col("center").alias("region_id"), *rest)
    return values.join(small_table(copies), ["sample_id", "center"], "left").select(
        "sample_id", F.coalesce("cell_id", "center").alias("region_id"), *rest,
    )


# Grid bucket of a row of the cell matrix, by which its rows are partitioned.
BUCKET = ["bx", "by"]


def cell_lri(
    cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables, size: float = 50.0, bucket: bool = False, **kw,
) -> DataFrame:
    """Cell x interaction matrix in long form; ``region_id`` is the center cell.

    Values are computed by the tile that sums up a neighborhood (``squares.cell_values``) and leave it in lists;
    they are not exchanged again. Where a bucket holds very many cells, or the pairs are many, sums leave their
    tiles and pairs are formed by grouping, once per distinct position. With ``bucket`` the rows keep BUCKET.
    """
    p = tables_of(pairs)
    place = BUCKET if bucket else []
    if p.is_small and not regions.has_dense_bucket(cells, size, **kw):
        types = _types(cells)
        values = _tile_values(cells, expression, p, size, types).select("sample_id", "region_id", *place, F.inline("found"))
        name = lambda of, i: F.get(F.array(*map(F.lit, of)).cast("array<string>"), i.cast("int"))
        pair, n_types = F.floor(F.col("kind") / len(squares.MODES)), max(1, len(types))
        return values.select(
            "sample_id", "region_id", *place, "lr_id", name(types, F.floor(pair / n_types)).alias("celltype1"),
            name(types, pair % n_types).alias("celltype2"), name(squares.MODES, F.col("kind") % len(squares.MODES)).alias("mode"), "value",
        )
    centers, copies = regions.position_ids(cells, size)
    counts = neighborhood_counts(cells, expression, p, size, centers, ids=("center",), **kw)
    values = pair_values(counts, p, ["sample_id", "bx", "by", "center"])
    return to_cells(values.select("sample_id", "center", *place, "lr_id", "celltype1", "celltype2", "mode", "value"), copies)


def _types(cells: DataFrame) -> list[str]:
    """The cell types in order."""
    return sorted(r["cell_type"] for r in cells.where("cell_type IS NOT NULL").select("cell_type").distinct().collect())


def cell_items(cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables) -> DataFrame:
    """(cells.*, items): the items that ``cell_features`` gives a cell, as one list; null if it has none."""
    fine_shuffles(cells.sparkSession)
    p = tables_of(pairs)
    hits = expression.where(F.col("count") > 0).join(p.panel, "gene", "left_semi").select("sample_id", "cell_id", "gene")
    items = (
        hits.join(p.features, "gene").groupBy("sample_id", "cell_id", "item").agg(F.count("*").alias("have"), F.first("need").alias("need"))
        .where("have = need").groupBy("sample_id", "cell_id").agg(F.collect_list("item").alias("items"))
    )
    joined = cells.hint("merge").join(items, ["sample_id", "cell_id"], "left")
    return joined.withColumn("items", F.when(F.col("cell_type").isNotNull(), F.col("items")))


def _tile_values(cells: DataFrame, expression: DataFrame, p: PairTables, size: float, types: list[str], numbers: dict | None = None) -> DataFrame:
    """(sample_id, region_id, BUCKET, found): lists of values of every cell, see ``squares.cell_values``."""
    sides = [tuple(r) for r in p.sides.select("item", "lr_id", "side").collect()]
    contact = {r["lr_id"]: r["is_contact"] for r in p.kinds.collect()}
    known = F.array(*map(F.lit, types)).cast("array<string>")
    listed = cell_items(cells, expression, p).select(
        "sample_id", "cell_id", "x", "y", (F.array_position(known, F.col("cell_type")) - 1).cast("int").alias("kind"), "items",
        *[regions._bucket(F.col(c), size / 2).alias(b) for c, b in (("x", "bx"), ("y", "by"))],
    )
    entry = "lr_id: int, kind: int" if numbers is None else "lri_idx: int"
    return regions.cell_tiles(
        listed, size, squares.cell_values(sides, contact, len(types), size / 2, numbers),
        {"sample_id": "sample_id", "region_id": "cell_id", "bx": "bx", "by": "by"},
        f"sample_id string, region_id bigint, bx bigint, by bigint, found array<struct<{entry}, value: bigint>>",
    )


def cell_lists(
    cells: DataFrame, expression: DataFrame, pairs: DataFrame | PairTables, columns: DataFrame, size: float = 50.0, **kw,
) -> DataFrame:
    """(sample_id, region_id, found): the row of every cell in the matrix aligned to ``columns`` (KEY and
    lri_idx), as one list of (lri_idx, value), empty rows left out."""
    p = tables_of(pairs)
    wanted = columns.select(*KEY, "lri_idx")
    local = local_copy(wanted)
    if p.is_small and local is not wanted and not regions.has_dense_bucket(cells, size, **kw):
        types = _types(cells)
        at = {t: i for i, t in enumerate(types)}
        numbers = {(r.lr_id, at[r.celltype1], at[r.celltype2], r.mode): r.lri_idx for r in local.collect() if r.celltype1 in at and r.celltype2 in at}
        return _tile_values(cells, expression, p, size, types, numbers).where("size(found) > 0").select("sample_id", "region_id", "found")
    matrix = indexed_matrix(cell_lri(cells, expression, p, size, **kw), columns)
    return matrix.groupBy("sample_id", "region_id").agg(F.collect_list(F.struct("lri_idx", "value")).alias("found"))


KEY = ["lr_id", "celltype1", "celltype2", "mode"]


def lri_columns(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns that occur in the matrix, numbered: long form holds no all-zero column."""
    keys = matrix.select(*KEY).distinct()
    return lrdb.number_lri(keys.join(small_table(pairs.select("lr_id", "ligand", "receptor")), "lr_id"))


def indexed_matrix(matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """(sample_id, region_id, lri_idx, value), and BUCKET if the matrix has it."""
    dim = small_table(columns.select(*KEY, "lri_idx"))
    return matrix.join(dim, KEY).select("sample_id", "region_id", *[c for c in BUCKET if c in matrix.columns], "lri_idx", "value")


def named_matrix(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, region_id, lri_name, value)."""
    named = matrix.join(small_table(pairs.select("lr_id", "ligand", "receptor")), "lr_id")
    return named.select(
        "sample_id", "region_id", lri_name("celltype1", "celltype2", "ligand", "receptor", "mode").alias("lri_name"), "value"
    )


def append_gene_features(named: DataFrame, regions_of_cells: DataFrame, expression: DataFrame, shared: DataFrame) -> DataFrame:
    """Add raw counts of shared genes as ``GENE|g`` columns, summed over each region."""
    rows = (
        expression.join(small_table(shared.select("gene")), "gene", "left_semi")
        .join(regions_of_cells, ["sample_id", "cell_id"])
        .groupBy("sample_id", "region_id", "gene").agg(F.sum("count").alias("value"))
    )
    return named.unionByName(rows.select(
        "sample_id", "region_id", F.concat(F.lit("GENE|"), F.col("gene")).alias("lri_name"), "value"
    ))


def align_columns(matrix: DataFrame, columns: DataFrame, required: DataFrame) -> DataFrame:
    """Keep the required columns, matched by name and numbered as required.

    ``columns`` (keys and names) may be those of the matrix or all possible ones: a required column
    without any count has no rows either way.
    """
    dim = wanted_columns(columns, required)
    kept = [c for c in BUCKET if c in matrix.columns]
    return matrix.join(small_table(dim), KEY).select("sample_id", "region_id", *kept, "lri_idx", "value")


def wanted_columns(columns: DataFrame, required: DataFrame) -> DataFrame:
    """KEY of the required columns, matched by name and numbered as required."""
    return columns.select(*KEY, "lri_name").join(required.select("lri_name", "lri_idx"), "lri_name").drop("lri_name")


def alignment_problems(model_names: DataFrame, cell_names: DataFrame) -> DataFrame:
    """One row of counts: repeated names on either side, and model names without a match."""
    repeats = lambda d, name: d.groupBy("lri_name").count().where("count > 1").agg(F.count("*").alias(name))
    missing = model_names.join(cell_names, "lri_name", "left_anti").agg(F.count("*").alias("missing"))
    return with_each(with_each(repeats(model_names, "model_repeats"), repeats(cell_names, "cell_repeats")), missing)


def require_aligned(model_names: DataFrame, cell_names: DataFrame) -> None:
    """Raise before a long projection starts if the columns cannot be matched by name."""
    p = alignment_problems(model_names, cell_names).first()
    require(p.model_repeats == 0 and p.cell_repeats == 0, "duplicate column names")
    require(p.missing == 0, f"{p.missing} model columns not found in the cell matrix")


def matrix_stats(matrix: DataFrame, n_regions: DataFrame, shared: DataFrame) -> DataFrame:
    """One row: regions, columns, nonzeros, sparsity as percent text, shared genes.

    ``n_regions`` is a one-row table with the number of regions, empty ones included.
    """
    cols = matrix.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_columns"), F.sum("n").alias("nnz"))
    genes = shared.agg(F.countDistinct("gene").alias("n_shared_genes"))
    one = with_each(with_each(cols, n_regions), genes)
    filled = F.col("nnz") / (F.col("n_regions") * F.col("n_columns"))
    return one.select(
        "n_regions", "n_columns", "nnz", "n_shared_genes",
        F.format_string("%.2f%%", (1 - filled) * 100).alias("sparsity"),
    )


def sample_info(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells, patches and global index range per sample."""
    n_cells = cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"))
    n_patches = patches.groupBy("sample_id").agg(
        F.count("*").alias("n_patches"), F.min("global_patch_idx").alias("global_patch_idx_start"),
        F.max("global_patch_idx").alias("global_patch_idx_end"),
    )
    return n_cells.join(n_patches, "sample_id")


def shared_genes(genes: DataFrame) -> DataFrame:
    """Genes present in the panel of every sample."""
    n_samples = small_table(genes.agg(F.countDistinct("sample_id").alias("n_samples")))
    present = genes.groupBy("gene").agg(F.countDistinct("sample_id").alias("n"))
    return present.join(n_samples, F.col("n") == F.col("n_samples")).select("gene")


def all_celltypes(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell types over all samples with cell counts, and the count of untyped cells."""
    counts = cells.groupBy("cell_type").agg(F.count("*").alias("n_cells"))
    return counts.where("cell_type IS NOT NULL"), counts.where("cell_type IS NULL")


def with_sample(merged: DataFrame, sample_column: str) -> DataFrame:
    """Merged input as multi-sample input: the sample is a key column; null samples drop."""
    keyed = merged if sample_column == "sample_id" else merged.withColumnRenamed(sample_column, "sample_id")
    return keyed.where(F.col("sample_id").isNotNull())


def stack_samples(tables: list[DataFrame]) -> DataFrame:
    """One table over several sources with equal columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
