"""Adapter from the driver's order tables to the library's tables, on both engines.

``Inputs`` builds Spark DataFrames; ``CTE`` holds the same definitions as DuckDB SQL. A
query's SQL names the CTEs it needs and ``sql()`` prepends them with their dependencies.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import schema as S
from cellweave.operators import interactions, lrdb
from cellweave.session import cut_lineage, local_copy

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 4

CELL_COLUMNS = """
    'S' || CAST(o_orderkey % 3 AS STRING) AS sample_id,
    o_orderkey AS cell_id,
    CAST((o_orderkey * 7919) % 8009 AS DOUBLE) / 8 AS x,
    CAST((o_orderkey * 104729) % 8011 AS DOUBLE) / 8 AS y,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS cell_type"""

PAIR_ROWS = [
    (0, "G00", "G01", "Secreted Signaling", "P0"),
    (1, "G02", "G03", "Cell-Cell Contact", "P1"),
    (2, "G04_G05", "G06", "Secreted Signaling", "P0"),
    (3, "G07", "G08,G09", "ECM-Receptor", "P2"),
    (4, "G10", "G99", "Secreted Signaling", "P2"),
    (5, "G11", "G12", None, "P3"),
    (6, "G13", "G14_G15", "Cell-Cell Contact", "P1"),
    (7, None, "G16", "Secreted Signaling", "P3"),
]

LOADING = """CASE WHEN (cell_id * 7 + k * 3) % 5 = 0 THEN CAST(8 * 16 + cell_id % 17 AS DOUBLE) / 16
     ELSE CAST(16 + cell_id % 13 AS DOUBLE) / 64 END"""
FACTOR = "CAST((lri_idx * 31 + k * 17) % 101 + 1 AS DOUBLE) / 64"

# A second LR database that grows with the part table.
PART_PAIRS = """
    CAST(p_partkey AS INT) AS lr_id,
    CASE WHEN p_partkey % 11 = 0 THEN NULL
         WHEN p_size % 3 = 0 THEN {l1} || '_' || {l2}
         WHEN p_size % 3 = 1 THEN {l1} || ',' || {l2} ELSE {l1} END AS ligand,
    CASE WHEN p_partkey % 13 = 0 THEN NULL
         WHEN p_partkey % 4 = 0 THEN {r1} || '_' || {r2} ELSE {r1} END AS receptor,
    CASE WHEN p_size % 4 = 0 THEN 'Cell-Cell Contact' WHEN p_size % 4 = 1 THEN NULL
         ELSE 'Secreted Signaling' END AS signaling_type,
    p_brand AS pathway""".format(
    l1="'G' || LPAD(CAST(p_partkey % 31 AS STRING), 2, '0')",
    l2="'G' || LPAD(CAST((p_partkey * 7) % 29 AS STRING), 2, '0')",
    r1="'G' || LPAD(CAST((p_partkey * 5) % 27 AS STRING), 2, '0')",
    r2="'G' || LPAD(CAST((p_partkey * 3) % 25 AS STRING), 2, '0')",
)

# Interaction names of every accepted shape, one per line item.
RAW_NAMES = """
    l_orderkey, l_linenumber,
    CASE l_linenumber % 6
      WHEN 0 THEN 'GENE|' || g1
      WHEN 1 THEN l_returnflag || '|' || l_linestatus || '|' || g1 || '_' || g2 || '|' || g3 || '|paracrine'
      WHEN 2 THEN l_returnflag || '|' || l_returnflag || '|' || g1 || '|' || g2
      WHEN 3 THEN g1 || '|' || g3
      WHEN 4 THEN l_returnflag || '|' || l_linestatus || '|' || g1 || ',' || g2 || '| ' || g3 || ' |juxtacrine|x'
      ELSE g1 END AS lri_name"""
RAW_GENES = """
    l_orderkey, l_linenumber, l_returnflag, l_linestatus,
    'G' || CAST(l_partkey % 40 AS STRING) AS g1, 'G' || CAST(l_suppkey % 30 AS STRING) AS g2,
    'R' || CAST(l_quantity AS INT) AS g3"""


class Inputs:
    """The library's tables, derived from one folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        return self.table("orders").selectExpr(*_columns(CELL_COLUMNS))

    def expression(self) -> DataFrame:
        gene = "'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0')"
        # Few lines share a cell and gene, so sums before the exchange would hold nearly every line of a split.
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("cell_id"), F.expr(gene).alias("gene"), "l_quantity")
            .repartition("cell_id").groupBy("cell_id", "gene")
            .agg(F.sum("l_quantity").cast("long").alias("count"))
            .select(F.expr("'S' || CAST(cell_id % 3 AS STRING)").alias("sample_id"), "cell_id", "gene", "count")
        )

    def genes(self) -> DataFrame:
        """Panel of each sample; one gene is absent from one sample."""
        seen = self.table("lineitem").selectExpr(
            "'S' || CAST(l_orderkey % 3 AS STRING) AS sample_id",
            "'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0') AS gene",
        )
        return seen.where("NOT (sample_id = 'S1' AND gene = 'G23')").distinct()

    def panel(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0') AS gene"
        ).distinct()

    def lr(self) -> DataFrame:
        return self.spark.createDataFrame(PAIR_ROWS, S.LR_PAIRS)

    def part_lr(self) -> DataFrame:
        return self.table("part").selectExpr(*_columns(PART_PAIRS))

    @cached_property
    def _pairs(self) -> DataFrame:
        return lrdb.usable_pairs(self.lr(), self.panel())

    def pairs(self) -> DataFrame:
        return self._pairs

    @cached_property
    def _matrix(self) -> DataFrame:
        # Stored once per query, as the batch stages do: its users read it several times.
        return cut_lineage(interactions.patch_lri(self.cells(), self.expression(), self.pairs()))

    def matrix(self) -> DataFrame:
        return self._matrix

    @cached_property
    def _lri(self) -> DataFrame:
        return local_copy(interactions.lri_columns(self.matrix(), self.pairs()))

    def lri(self) -> DataFrame:
        return self._lri

    def motifs(self) -> DataFrame:
        return self.spark.range(K).selectExpr("CAST(id AS INT) AS motif")

    def loadings(self) -> DataFrame:
        ks = F.explode(F.array(*[F.lit(k) for k in range(K)])).alias("k")
        return (
            self.cells().select("sample_id", "cell_id", ks)
            .select("sample_id", "cell_id", F.col("k").alias("motif"), F.expr(LOADING).alias("loading"))
        )

    def patch_loadings(self) -> DataFrame:
        """Stand-in W: one loading per occupied patch and motif."""
        from cellweave.operators import regions

        patches = regions.assign_patches(self.cells()).where("patch_id IS NOT NULL")
        ids = patches.select("sample_id", F.col("patch_id").alias("cell_id")).distinct()
        ks = F.explode(F.array(*[F.lit(k) for k in range(K)])).alias("k")
        return ids.select("sample_id", "cell_id", ks).select(
            "sample_id", F.col("cell_id").alias("region_id"), F.col("k").alias("motif"), F.expr(LOADING).alias("loading")
        )

    def factors(self) -> DataFrame:
        ks = F.explode(F.array(*[F.lit(k) for k in range(K)])).alias("k")
        return self.lri().select("lri_idx", ks).select(
            "lri_idx", F.col("k").alias("motif"), F.expr(FACTOR).alias("factor")
        )

    def states(self) -> DataFrame:
        return self.loadings().select(
            "sample_id", "cell_id", "motif",
            F.when(F.col("loading") > 1, "positive").otherwise("negative").alias("state"),
        )


def _columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, cur, quoted = [], 0, "", False
    for ch in text:
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [c.strip() for c in [*out, cur]]


def _values() -> str:
    show = lambda v: "NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'")
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in PAIR_ROWS)


def _pair_ctes(p: str, lr: str) -> dict[str, str]:
    """CTEs of one LR database: exploded genes, coverage, usable pairs."""
    return {
        f"{p}genes": f"""
  SELECT DISTINCT lr_id, 'L' AS side, unnest(string_split(replace(ligand, ',', '_'), '_')) AS gene FROM {lr}
  UNION SELECT DISTINCT lr_id, 'R', unnest(string_split(replace(receptor, ',', '_'), '_')) FROM {lr}""",
        f"{p}cov": f"""
  SELECT lr_id, bool_and(side <> 'L' OR p.gene IS NOT NULL) AS ligand_ok,
         bool_and(side <> 'R' OR p.gene IS NOT NULL) AS receptor_ok
  FROM {p}genes g JOIN {lr} USING (lr_id) LEFT JOIN panel p ON g.gene = p.gene
  WHERE ligand IS NOT NULL AND receptor IS NOT NULL GROUP BY lr_id""",
        f"{p}usable": f"""
  SELECT min(lr_id) AS lr_id, ligand, receptor, coalesce(signaling_type, 'Unknown') AS signaling_type,
         arg_min(pathway, lr_id) AS pathway
  FROM {lr} JOIN {p}cov USING (lr_id) WHERE ligand_ok AND receptor_ok
  GROUP BY ligand, receptor, coalesce(signaling_type, 'Unknown')""",
    }


def _matrix_ctes(p: str, region_join: str) -> dict[str, str]:
    """CTEs counting interactions over the membership relation of one kind of region."""
    return {
        f"{p}gc": f"""
  SELECT m.sample_id, m.region_id, c.cell_type, e.gene, count(*) AS n
  FROM {region_join} m JOIN cells c ON m.sample_id = c.sample_id AND m.cell_id = c.cell_id
  JOIN expression e ON e.cell_id = c.cell_id
  WHERE c.cell_type IS NOT NULL AND e.count > 0 AND e.gene IN (SELECT gene FROM ugenes)
  GROUP BY ALL""",
        f"{p}cx": f"""
  SELECT sample_id, region_id, cell_type, lr_id, side, min(n) AS n
  FROM {p}gc JOIN ugenes USING (gene) JOIN uneed USING (lr_id, side)
  GROUP BY sample_id, region_id, cell_type, lr_id, side HAVING count(*) = any_value(need)""",
        f"{p}auto": f"""
  SELECT m.sample_id, m.region_id, co.cell_type, co.lr_id, count(*) AS n
  FROM {region_join} m JOIN coexpr co ON m.sample_id = co.sample_id AND m.cell_id = co.cell_id GROUP BY ALL""",
        f"{p}cross": f"""
  SELECT l.sample_id, l.region_id, l.lr_id, l.cell_type AS celltype1, r.cell_type AS celltype2,
         l.n * r.n AS lr, coalesce(a.n, 0) AS au, u.signaling_type
  FROM {p}cx l JOIN {p}cx r ON l.sample_id = r.sample_id AND l.region_id = r.region_id AND l.lr_id = r.lr_id
    AND l.side = 'L' AND r.side = 'R'
  JOIN lrusable u ON u.lr_id = l.lr_id
  LEFT JOIN {p}auto a ON a.sample_id = l.sample_id AND a.region_id = l.region_id AND a.lr_id = l.lr_id
    AND a.cell_type = l.cell_type AND l.cell_type = r.cell_type""",
        f"{p}matrix": f"""
  SELECT sample_id, region_id, lr_id, celltype1, celltype2, mode, CAST(value AS BIGINT) AS value FROM (
    SELECT *, 'juxtacrine' AS mode, lr - au AS value FROM {p}cross WHERE signaling_type = 'Cell-Cell Contact'
    UNION ALL SELECT *, 'autocrine', au FROM {p}cross WHERE signaling_type <> 'Cell-Cell Contact' AND celltype1 = celltype2
    UNION ALL SELECT *, 'paracrine', lr - au FROM {p}cross WHERE signaling_type <> 'Cell-Cell Contact')
  WHERE value <> 0""",
    }


CTE: dict[str, str] = {
    "cells": f"SELECT {CELL_COLUMNS} FROM orders",
    "expression": """
  SELECT 'S' || CAST(l_orderkey % 3 AS STRING) AS sample_id, l_orderkey AS cell_id,
         'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0') AS gene, CAST(SUM(l_quantity) AS BIGINT) AS count
  FROM lineitem GROUP BY ALL""",
    "genes": """
  SELECT DISTINCT sample_id, gene FROM expression WHERE NOT (sample_id = 'S1' AND gene = 'G23')""",
    "panel": "SELECT DISTINCT 'G' || LPAD(CAST(l_partkey % 24 AS STRING), 2, '0') AS gene FROM lineitem",
    "lr": f"SELECT * FROM (VALUES {_values()}) t(lr_id, ligand, receptor, signaling_type, pathway)",
    **_pair_ctes("lr", "lr"),
    "partlr": f"SELECT {PART_PAIRS} FROM part",
    **_pair_ctes("part", "partlr"),
    "ugenes": "SELECT g.* FROM lrgenes g JOIN lrusable USING (lr_id)",
    "extents": """
  SELECT sample_id, min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) + 50 - min(x)) / 50) AS BIGINT) AS nx,
         CAST(ceil((max(y) + 50 - min(y)) / 50) AS BIGINT) AS ny FROM cells GROUP BY ALL""",
    "placed": """
  SELECT c.*, x0, y0, nx, ny, CAST(floor((x - x0) / 50) AS BIGINT) AS xi, CAST(floor((y - y0) / 50) AS BIGINT) AS yi
  FROM cells c JOIN extents USING (sample_id)""",
    "patches": """
  SELECT *, CASE WHEN xi < nx - 1 AND yi < ny - 1 THEN xi * ny + yi END AS patch_id FROM placed""",
    "pmember": "SELECT sample_id, patch_id AS region_id, cell_id FROM patches WHERE patch_id IS NOT NULL",
    "patchtable": """
  SELECT sample_id, patch_id, xi, yi, x0 + xi * 50 + 25.0 AS x_center, y0 + yi * 50 + 25.0 AS y_center, count(*) AS n_cells,
         dense_rank() OVER (PARTITION BY sample_id ORDER BY patch_id) - 1 AS patch_idx,
         dense_rank() OVER (ORDER BY sample_id, patch_id) - 1 AS global_patch_idx
  FROM patches WHERE patch_id IS NOT NULL GROUP BY sample_id, patch_id, xi, yi, x0, y0""",
    "edges": """
  SELECT c.sample_id, c.cell_id AS center_id, p.cell_id AS nbr_id FROM cells c JOIN cells p
    ON c.sample_id = p.sample_id AND p.x BETWEEN c.x - 25 AND c.x + 25 AND p.y BETWEEN c.y - 25 AND c.y + 25""",
    "nmember": "SELECT sample_id, center_id AS region_id, nbr_id AS cell_id FROM edges",
    "coexpr": """
  SELECT c.sample_id, c.cell_id, c.cell_type, u.lr_id FROM cells c JOIN expression e ON e.cell_id = c.cell_id
  JOIN (SELECT DISTINCT lr_id, gene FROM ugenes) u ON u.gene = e.gene
  JOIN (SELECT lr_id, count(DISTINCT gene) AS need FROM ugenes GROUP BY lr_id) d ON d.lr_id = u.lr_id
  WHERE c.cell_type IS NOT NULL AND e.count > 0 GROUP BY c.sample_id, c.cell_id, c.cell_type, u.lr_id
  HAVING count(*) = any_value(need)""",
    "uneed": "SELECT lr_id, side, count(*) AS need FROM ugenes GROUP BY lr_id, side",
    **_matrix_ctes("p", "pmember"),
    **_matrix_ctes("n", "nmember"),
    "lri": """
  SELECT lr_id, celltype1, celltype2, ligand, receptor, mode, pathway,
         CAST(row_number() OVER (ORDER BY lr_id, celltype1, celltype2, mode) - 1 AS INT) AS lri_idx,
         concat_ws('|', celltype1, celltype2, ligand, receptor, mode) AS lri_name
  FROM (SELECT DISTINCT lr_id, celltype1, celltype2, mode FROM pmatrix) JOIN lrusable USING (lr_id)""",
    "pwkeys": """
  SELECT lr_id * 1000 + i * 10 + j AS ord, string_split(ligand, '_')[i] AS lig, string_split(receptor, '_')[j] AS rec, pathway
  FROM (SELECT *, unnest(range(1, len(string_split(ligand, '_')) + 1)) AS i FROM partlr) l
  JOIN (SELECT lr_id, unnest(range(1, len(string_split(receptor, '_')) + 1)) AS j FROM partlr) r USING (lr_id)
  UNION ALL SELECT lr_id * 1000 + 999, ligand, receptor, pathway FROM partlr
  WHERE ligand IS NOT NULL AND receptor IS NOT NULL""",
    "pwmap": "SELECT lig, rec, min(ord) AS ord, arg_max(pathway, ord) AS pathway FROM pwkeys GROUP BY ALL",
    "ks": f"SELECT CAST(range AS INT) AS k FROM range({K})",
    "loadings": f"SELECT sample_id, cell_id, k AS motif, {LOADING} AS loading FROM cells, ks",
    "wload": f"""
  SELECT sample_id, cell_id AS region_id, k AS motif, {LOADING} AS loading
  FROM (SELECT DISTINCT sample_id, region_id AS cell_id FROM pmember), ks""",
    "factors": f"SELECT lri_idx, k AS motif, {FACTOR} AS factor FROM lri, ks",
    "states": "SELECT sample_id, cell_id, motif, CASE WHEN loading > 1 THEN 'positive' ELSE 'negative' END AS state FROM loadings",
    "rawgenes": f"SELECT {RAW_GENES} FROM lineitem",
    "rawnames": f"SELECT {RAW_NAMES} FROM rawgenes",
}
@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    words = set(re.findall(r"[a-z_0-9]+", CTE[name]))
    return tuple(c for c in CTE if c in words and c != name)


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs that ``body`` mentions, dependencies first."""
    for k, v in (extra or {}).items():
        CTE[k] = v
        _needs.cache_clear()
    order: list[str] = []

    def visit(name: str, path: tuple = ()) -> None:
        if name in order or name in path:
            return
        for d in _needs(name):
            visit(d, (*path, name))
        order.append(name)

    words = set(re.findall(r"[a-z_0-9]+", body))
    for c in list(CTE):
        if c in words:
            visit(c)
    ctes = ",\n".join(f"{c} AS ({CTE[c]})" for c in order)
    return f"WITH {ctes}\n{body}" if order else body


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the DuckDB body (CTEs are added)."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            SQL[name] = sql(oracle)
        return fn

    return register


def r6(col, alias: str):
    """Round a double for comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(alias)
