"""Cell matrix and neighbor pairs: what moves between tasks, and what a task holds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cellweave.operators import interactions, regions, squares

SF_DIR = "/root/testdata/sf0.01"


def shuffled_rows(spark, run):
    """The most rows that one stage of ``run`` hands to a shuffle, and what it returns."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return max((n for s, n in stages().items() if s not in before), default=0), out


@pytest.mark.parametrize("name", ["sink_cell_lri", "src_cell_lri"])
def test_stored_matrix_is_not_exchanged(spark, name):
    most, total = shuffled_rows(spark, lambda: queries()[name](spark, SF_DIR).selectExpr(
        "count(*) AS n" if name == "sink_cell_lri" else "sum(n_columns) AS n").first()["n"])
    assert total == 141_280
    assert most < total


def uniform_cells(spark, n=4_000):
    rng = np.random.default_rng(3)
    rows = [("S", i, float(x), float(y), "AB"[i % 2]) for i, (x, y) in enumerate(rng.uniform(0, 1_000, (n, 2)))]
    return spark.createDataFrame(rows, "sample_id string, cell_id long, x double, y double, cell_type string").repartition(8)


def test_neighbor_pairs_exchange_few_copies_of_a_cell(spark):
    cells = uniform_cells(spark)
    most, _ = shuffled_rows(spark, lambda: regions.neighbor_edges(cells).count())
    assert most < 3 * 4_000


def test_matrix_exchanges_few_copies_of_a_cell(spark):
    cells = uniform_cells(spark)
    expression = cells.select("sample_id", "cell_id", F.lit("G").alias("gene"), F.lit(1).cast("long").alias("count"))
    pairs = spark.createDataFrame([(0, "G", "G", "Secreted Signaling", "P")], "lr_id int, ligand string, receptor string, signaling_type string, pathway string")
    most, _ = shuffled_rows(spark, lambda: interactions.cell_lri(cells, expression, pairs).count())
    assert most < 3 * 4_000


def tile(rng, n, spots):
    """A tile of 4 buckets of 10 and what lies within reach; a third of the cells share one position, some have no items."""
    x, y = rng.uniform(-10, 50, n).round(1), rng.uniform(-10, 50, n).round(1)
    x[: n // spots], y[: n // spots] = 20.5, 20.5
    items = [None if i % 7 == 0 else [[1], [2], [1, 2, -1]][rng.integers(3)] for i in range(n)]
    return x, y, items, pa.record_batch({
        "sample_id": pa.array(["S"] * n), "cell_id": pa.array(range(n), pa.int64()), "x": x, "y": y, "kind": pa.array([i % 3 if i % 7 else None for i in range(n)], pa.int32()),
        "items": pa.array(items, pa.list_(pa.int32())), "tx": pa.array([0] * n), "ty": pa.array([0] * n),
    })


@pytest.mark.parametrize("totals", [8_000_000, 300])
def test_a_task_holds_some_values_of_its_tile(monkeypatch, totals):
    monkeypatch.setattr(squares, "VALUES", 100)
    monkeypatch.setattr(squares, "TOTALS", totals)
    x, y, items, batch = tile(np.random.default_rng(1), 400, 3)
    part = squares.cell_values([(1, 0, "L"), (2, 0, "R"), (-1, 0, "A")], {0: False}, 3, 10.0)
    run = squares.parts_function(10.0, 4, part, {"region_id": "cell_id"})
    out = [r for b in run(iter([batch.slice(0, 150), batch.slice(150)])) for r in [b.to_pydict()]]
    assert max(sum(map(len, b["found"])) for b in out) <= 100
    got = {(c, v["kind"]): v["value"] for b in out for c, found in zip(b["region_id"], b["found"]) for v in found}
    want, width = {}, 10 * (1 + 1e-9)
    has = lambda k, item: np.array([i % 3 == k and it is not None and item in it for i, it in enumerate(items)])
    for c in range(len(x)):
        if not (0 <= x[c] // width < 4 and 0 <= y[c] // width < 4):
            continue
        near = (x >= x[c] - 10) & (x <= x[c] + 10) & (y >= y[c] - 10) & (y <= y[c] + 10)
        for a in range(3):
            for b in range(3):
                auto = int((near & has(a, -1)).sum()) if a == b else 0
                between = int((near & has(a, 1)).sum() * (near & has(b, 2)).sum()) - auto
                want |= {(c, (a * 3 + b) * 3 + m): v for m, v in ((0, auto), (1, between)) if v}
    assert got == want


def test_a_task_holds_some_neighbors_of_its_tile(monkeypatch):
    monkeypatch.setattr(squares, "VALUES", 50)
    monkeypatch.setattr(squares, "RUN_POINTS", 8)
    x, y, _, batch = tile(np.random.default_rng(2), 300, 30)
    out = [b.to_pydict() for b in squares.parts_function(10.0, 4, squares.cell_neighbors(10.0), {"center_id": "cell_id"})(iter([batch]))]
    # One run of one center is the least that is handed on.
    assert max(sum(map(len, b["found"])) for b in out) <= 50 + 30
    got = sorted((c, n) for b in out for c, found in zip(b["center_id"], b["found"]) for n in found)
    width, each = 10 * (1 + 1e-9), range(len(x))
    at_home = [c for c in each if 0 <= x[c] // width < 4 and 0 <= y[c] // width < 4]
    assert got == [(c, n) for c in at_home for n in each if x[c] - 10 <= x[n] <= x[c] + 10 and y[c] - 10 <= y[n] <= y[c] + 10]


def test_dense_buckets_are_joined(spark):
    cells = uniform_cells(spark, 600)
    pairs = [{(r.center_id, r.nbr_id) for r in regions.neighbor_edges(cells, 200.0, hot=hot).collect()} for hot in (5, 65_536)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 600
