import pytest
from pyspark.sql import functions as F

from cellweave.functions import names
from cellweave.operators import interactions, lrdb, motifs, states
from cellweave.plans import jobs
from cellweave.session import local_copy, scratch_path, small_table, with_each
from cellweave.sources import readers, writers

LR = "lr_id int, ligand string, receptor string, signaling_type string, pathway string"


def test_lri_genes_of_three_names(spark):
    rows = [("T cell|B cell|IL2|IL2RA_IL2RB|paracrine",), ("A|A|TGFB1|TGFBR1_TGFBR2|autocrine",), (None,), ("a|b",)]
    got = {r.gene for r in names.extract_lri_genes(spark.createDataFrame(rows, "lri_name string")).collect()}
    assert got == {"IL2", "IL2RA", "IL2RB", "TGFB1", "TGFBR1", "TGFBR2"}
    comma = spark.createDataFrame([("a|b|X,Y|Z|m",)], "lri_name string")
    assert {r.gene for r in names.extract_lri_genes(comma).collect()} == {"X,Y", "Z"}
    assert {r.gene for r in names.extract_lri_genes(comma, split_commas=True).collect()} == {"X", "Y", "Z"}


def test_lr_database_csv(spark):
    path = scratch_path(spark, "lr") + ".csv"
    spark.createDataFrame([("L1_L2", "R1", None, "P"), ("L3", "R2", "Cell-Cell Contact", None)],
                          "ligand string, receptor string, signaling_type string, pathway string").coalesce(1).write.csv(path, header=True)
    got = readers.read_lr_database(spark, path).orderBy("lr_id").collect()
    assert [(r.lr_id, r.signaling_type, r.pathway) for r in got] == [(0, "Unknown", "P"), (1, "Cell-Cell Contact", None)]
    bad = scratch_path(spark, "lr") + ".csv"
    spark.createDataFrame([("L", "R")], "ligand string, receptor string").write.csv(bad, header=True)
    with pytest.raises(ValueError):
        readers.read_lr_database(spark, bad)
    assert readers.read_lr_database(spark, bad, require_type=False).first().signaling_type == "Unknown"


def test_samplesheet_and_missing_columns(spark):
    rows = [("s1", "/a/x.parquet"), ("s 2", "/a/x.parquet"), ("s3", "/a/x.h5"), (None, "/a/x.csv")]
    ok, bad = readers.split_samplesheet(spark.createDataFrame(rows, "sample_id string, data_path string"))
    assert [r.sample_id for r in ok.collect()] == ["s1"] and bad.count() == 3
    with pytest.raises(ValueError):
        readers.check_cells(spark.createDataFrame([("s", 1, 0.0)], "sample_id string, cell_id long, x double"))
    expr = spark.createDataFrame([("s", 1, "g", "X", 1)], "sample_id string, cell_id long, gene string, layer string, count long")
    with pytest.raises(ValueError):
        readers.select_layer(expr, "raw")


def test_usable_pairs_keep_first_duplicate(spark):
    lr = spark.createDataFrame(
        [(0, "A", "B", "x", "p"), (1, "A", "B", "x", "q"), (2, "A", "B", None, "r"), (3, "A__B", "B", "x", "s"), (4, "A", "C", "x", "t")], LR)
    panel = spark.createDataFrame([("A",), ("B",)], "gene string")
    assert {(r.lr_id, r.pathway) for r in lrdb.usable_pairs(lr, panel).collect()} == {(0, "p"), (2, "r")}
    with pytest.raises(ValueError):
        lrdb.require_unique_pairs(lr)


def test_pathway_order_rules(spark):
    lr = spark.createDataFrame([
        (0, "AB_C", "R1", "x", "first"), (1, "AB", "R1", "x", "last"), (2, "Q", "RR", "x", "q"), (3, "QQ", "RRR", "x", "qq"),
    ], LR)
    df = spark.createDataFrame([("AB", "R1"), ("AB_C", "R1"), ("A", "R"), ("QQQ", "RR"), ("none", "none")], "ligand string, receptor string")
    got = {r.ligand: r.pathway for r in lrdb.annotate_pathways(df, lr).collect()}
    # exact: last row wins; fuzzy: earliest key position, with that key's last value.
    assert got == {"AB": "last", "AB_C": "first", "A": "last", "QQQ": "q", "none": "Unknown"}


def test_alignment_errors(spark):
    model = spark.createDataFrame([("a",), ("b",)], "lri_name string")
    interactions.require_aligned(model, spark.createDataFrame([("b",), ("a",), ("c",)], "lri_name string"))
    with pytest.raises(ValueError, match="not found"):
        interactions.require_aligned(model, spark.createDataFrame([("a",)], "lri_name string"))
    with pytest.raises(ValueError, match="duplicate"):
        interactions.require_aligned(model, spark.createDataFrame([("a",), ("b",), ("b",)], "lri_name string"))


def test_outlier_edges_skip_and_continue(spark):
    edges = [(0, "a", "b", 100.0), (0, "c", "d", 90.0), (0, "e", "a", 80.0), (0, "b", "c", 70.0)] + [(0, f"x{i}", "y", 1.0 + i / 100) for i in range(20)]
    df = spark.createDataFrame(edges, "motif int, celltype1 string, celltype2 string, weight double")
    got = [(r.celltype1, r.celltype2) for r in motifs.outlier_edges(df).orderBy(F.desc("weight")).collect()]
    assert got == [("a", "b"), ("c", "d"), ("b", "c")]
    assert motifs.outlier_edges(df, max_celltypes=1).isEmpty()


def test_gate_of_empty_motif_keeps_everything(spark):
    edges = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "b", 5.0), (1, "a", "b", 1.0)], "motif int, celltype1 string, celltype2 string, weight double")
    kept = motifs.apply_gate(edges, edges.where("weight > 2").select("motif", "celltype1", "celltype2"))
    assert {(r.motif, r.weight) for r in kept.collect()} == {(0, 5.0), (1, 1.0)}


def test_grades_exact_test(spark):
    rows = [(0, f"p{i}", i / 10, "low" if i < 3 else "high") for i in range(7)]
    f = spark.createDataFrame(rows, "motif int, group string, fraction double, grade string")
    r = states.compare_grades(f, "low", "high").first()
    assert (r.n1, r.n2, r.u1) == (4, 3, 12.0) and r.pval == pytest.approx(2 / 35)


def test_small_tables_are_checked(spark):
    big = spark.range(50)
    assert local_copy(big, 10) is big and small_table(big, 10) is big
    assert "LocalTableScan" in local_copy(big, 50)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        with_each(big, big, 10)


def test_de_results_are_never_overwritten(spark):
    d = spark.createDataFrame([(0, "T/x y", "g", 1.0)], "motif int, cell_type string, gene string, qval double")
    path = writers.write_de(d, scratch_path(spark, "de"))
    assert readers.read_results(spark, path).first().cell_type == "T/x y"
    with pytest.raises(Exception, match="exists"):
        writers.write_de(d, path)


def test_model_round_trip(spark):
    from cellweave.operators import factorize

    m = spark.createDataFrame([("S", 1, 0, 4), ("S", 2, 1, 3)], "sample_id string, region_id long, lri_idx int, value long")
    model = factorize.fit(m, m.select("sample_id", "region_id"), m.select("lri_idx"), 2, 2, None)
    out = scratch_path(spark, "model")
    jobs.save_model(model, out)
    back = jobs.load_model(spark, out)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert back.k == 2 and back.row_beta == model.row_beta
    assert key(back.column_factors()) == key(model.column_factors())


def test_lines_are_summed_after_their_exchange_only(spark):
    from catalog.base import Inputs

    lines = Inputs(spark, "/root/testdata/sf0.001").expression()._jdf.queryExecution().executedPlan().toString().splitlines()
    exchange = [i for i, x in enumerate(lines) if "Exchange" in x]
    # Plans are printed from the top: nothing is summed below the exchange.
    assert len(exchange) == 1 and all(i < exchange[0] for i, x in enumerate(lines) if "HashAggregate" in x)


#: Queries whose lines must be exchanged before they are summed, in every plan they run or store.
LINE_SUMS = [
    "agg_comm_matrix",
    "agg_complex_min",
    "agg_diagnostics",
    "agg_diagnostics_hist",
    "agg_drop_zero_cols",
    "agg_factor_dist",
    "agg_factor_scatter",
    "agg_factor_sparsity",
    "agg_gene_region",
    "agg_lr_prevalence",
    "agg_lri_motifs",
    "agg_matrix_stats",
    "agg_network",
]


@pytest.mark.parametrize("name", LINE_SUMS)
def test_no_scan_of_lines_sums_them(spark, monkeypatch, name):
    from __spark_entry__ import base, queries

    stored, plans = base.cut_lineage, []
    monkeypatch.setattr(base, "cut_lineage", lambda df: (plans.append(df), stored(df))[1])
    plans.append(queries()[name](spark, "/root/testdata/sf0.001"))
    sums = 0
    for df in plans:
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for i in (i for i, x in enumerate(lines) if "partial_sum" in x and "l_quantity" in x):
            scan = next(j for j in range(i, len(lines)) if "Scan parquet" in lines[j])
            assert any("Exchange" in x for x in lines[i:scan])
            sums += 1
    assert sums
