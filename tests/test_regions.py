import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import interactions, regions


def make_cells(spark, rng, n=240, hot=80, types=("A", "B", None)):
    """Random cells on a coarse grid of positions; ``hot`` of them share a small spot."""
    rows = []
    for i in range(n):
        if i < hot:
            x, y = 100 + rng.integers(0, 24) / 8, 100 + rng.integers(0, 24) / 8
        else:
            x, y = rng.integers(0, 400) / 2, rng.integers(0, 400) / 2
        rows.append((f"S{i % 2}", i, float(x), float(y), types[rng.integers(len(types))]))
    # A third group: exact copies of one position.
    rows += [("S0", n + i, 60.0, 60.0, "A") for i in range(40)]
    return spark.createDataFrame(rows, "sample_id string, cell_id long, x double, y double, cell_type string"), rows


def test_patches_match_digitize(spark):
    rng = np.random.default_rng(1)
    rows = [("S", i, float(x), float(y), "A") for i, (x, y) in enumerate(rng.uniform(-3, 77, (300, 2)))]
    rows += [("S", 300 + i, -3.0 + 7.3 * i, 1.0, "A") for i in range(5)]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id long, x double, y double, cell_type string")
    size = 7.3
    got = {r.cell_id: r.patch_id for r in regions.assign_patches(cells, size).collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    ex, ey = np.arange(x.min(), x.max() + size, size), np.arange(y.min(), y.max() + size, size)
    xi, yi = np.digitize(x, ex) - 1, np.digitize(y, ey) - 1
    want = [int(a * len(ey) + b) if a < len(ex) - 1 and b < len(ey) - 1 else None for a, b in zip(xi, yi)]
    assert [got[r[1]] for r in rows] == want


def test_dense_index_follows_patch_order(spark):
    cells, _ = make_cells(spark, np.random.default_rng(2))
    t = regions.patch_table(regions.assign_patches(cells, 20.0), 20.0).orderBy("sample_id", "patch_id").collect()
    assert [r.global_patch_idx for r in t] == list(range(len(t)))
    for s in ("S0", "S1"):
        assert [r.patch_idx for r in t if r.sample_id == s] == list(range(sum(r.sample_id == s for r in t)))


@pytest.mark.parametrize("hot", [10_000, 12, 2])
def test_square_sums_match_pairs_with_and_without_quadtree(spark, hot):
    rng = np.random.default_rng(3)
    cells, rows = make_cells(spark, rng)
    weights = cells.groupBy("sample_id", "x", "y", F.coalesce("cell_type", F.lit("none")).alias("item")).agg(F.count("*").alias("n"))
    sums = regions.square_sums(regions.positions(cells, 20.0), weights, 20.0, ["item"], hot=hot)
    got = {(r.sample_id, r.cx, r.cy, r.item): r.n for r in sums.collect()}
    want = {}
    for a in rows:
        counts = {}
        for b in near(rows, a, 10.0):
            counts[b[4] or "none"] = counts.get(b[4] or "none", 0) + 1
        for k, v in counts.items():
            want[(a[0], a[2], a[3], k)] = v
    assert got == want


def near(rows, a, half):
    return [b for b in rows if b[0] == a[0] and a[2] - half <= b[2] <= a[2] + half and a[3] - half <= b[3] <= a[3] + half]


def test_edges_and_sizes(spark):
    cells, rows = make_cells(spark, np.random.default_rng(4))
    got = {(r.sample_id, r.center_id, r.nbr_id) for r in regions.neighbor_edges(cells, 20.0).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in near(rows, a, 10.0)}
    assert got == want
    sizes = {(r.sample_id, r.cell_id): r.n_neighbors for r in regions.neighborhood_sizes(cells, 20.0).collect()}
    assert sizes == {(a[0], a[1]): len(near(rows, a, 10.0)) for a in rows}


def test_bucket_reach_at_rounding_edge(spark):
    cx = float(np.nextafter(25.0, 0))
    cells = spark.createDataFrame(
        [("S", 1, cx, 0.0, "A"), ("S", 2, 50.0, 0.0, "A"), ("S", 3, -0.0, 0.0, "B")],
        "sample_id string, cell_id long, x double, y double, cell_type string",
    )
    got = {(r.center_id, r.nbr_id) for r in regions.neighbor_edges(cells, 50.0).collect()}
    pos = {1: cx, 2: 50.0, 3: 0.0}
    assert got == {(a, b) for a in pos for b in pos if pos[a] - 25 <= pos[b] <= pos[a] + 25}


PAIRS = [
    (0, "g0", "g1", "Secreted Signaling", "P"), (1, "g2_g3", "g4", "Cell-Cell Contact", "P"),
    (2, "g1,g1", "g1_g5", None, "Q"), (3, "g0", "g0", "Secreted Signaling", "Q"),
]


def brute(rows, expr, members, pairs):
    """Counts per region by plain loops over cell types and pairs."""
    import re

    out = {}
    types = sorted({r[4] for r in rows if r[4]})
    for region, cells in members.items():
        for lr, lig, rec, kind, _ in pairs:
            lg, rg = re.split("[_,]", lig), re.split("[_,]", rec)
            n = {(t, g): sum(1 for c in cells if c[4] == t and g in expr.get(c[1], ())) for t in types for g in {*lg, *rg}}
            for a in types:
                for b in types:
                    prod = min(n[a, g] for g in lg) * min(n[b, g] for g in rg)
                    auto = sum(1 for c in cells if a == b == c[4] and {*lg, *rg} <= expr.get(c[1], set()))
                    modes = {"juxtacrine": prod - auto} if kind == "Cell-Cell Contact" else (
                        {"autocrine": auto, "paracrine": prod - auto} if a == b else {"paracrine": prod})
                    for m, v in modes.items():
                        if v:
                            out[(*region, lr, a, b, m)] = v
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_matrices_match_plain_loops(spark, hot):
    rng = np.random.default_rng(5)
    cells, rows = make_cells(spark, rng, n=120, hot=40)
    expr = {r[1]: {f"g{k}" for k in range(6) if rng.random() < 0.5} for r in rows}
    expression = spark.createDataFrame(
        [(r[0], r[1], g, int(rng.integers(1, 4))) for r in rows for g in expr[r[1]]] + [(rows[0][0], rows[0][1], "other", 0)],
        "sample_id string, cell_id long, gene string, count long",
    )
    pairs = spark.createDataFrame(PAIRS, "lr_id int, ligand string, receptor string, signaling_type string, pathway string").na.fill("Unknown")
    placed = regions.assign_patches(cells, 20.0).collect()
    members = {}
    for r in placed:
        if r.patch_id is not None:
            members.setdefault((r.sample_id, r.patch_id), []).append((r.sample_id, r.cell_id, r.x, r.y, r.cell_type))
    as_dict = lambda df: {(r.sample_id, r.region_id, r.lr_id, r.celltype1, r.celltype2, r.mode): r.value for r in df.collect()}
    assert as_dict(interactions.patch_lri(cells, expression, pairs, 20.0)) == brute(rows, expr, members, PAIRS)
    around = {(a[0], a[1]): near(rows, a, 10.0) for a in rows}
    assert as_dict(interactions.cell_lri(cells, expression, pairs, 20.0, hot=hot)) == brute(rows, expr, around, PAIRS)


def test_edges_never_broadcast_cells(spark):
    cells, _ = make_cells(spark, np.random.default_rng(5))
    assert "Broadcast" not in regions.neighbor_edges(cells, 20.0)._jdf.queryExecution().simpleString()


def test_shuffles_are_cut_by_bytes_before_features_are_grouped(spark):
    parts, size, split = (
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
    )
    old = {c: spark.conf.get(c, None) for c in (parts, size, split)}
    try:
        spark.conf.unset(parts)
        spark.conf.set(size, "64m")
        spark.conf.set(split, "1m")
        cells, _ = make_cells(spark, np.random.default_rng(6))
        expression = cells.select("sample_id", "cell_id", F.lit("G").alias("gene"), F.lit(1).cast("long").alias("count"))
        pairs = spark.createDataFrame([(0, "G", "G", "Secreted Signaling", "P")], "lr_id int, ligand string, receptor string, signaling_type string, pathway string")
        interactions.cell_features(cells, expression, pairs)
        assert int(spark.conf.get(parts)) >= 200
        assert spark.conf.get(size) == "8m"
        assert spark.conf.get(split) == "1m"  # already smaller: kept
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
