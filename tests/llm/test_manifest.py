import hashlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, the siblings on its way, by following one leaf after another."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
            way.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    """rows of (key, group, leaf) -> sorted (key, group, leaf, subroot, root, proof)."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((-(2**63) if key is None else key, leaf, key))
    tops, found = [], []
    for group in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[group], key=lambda m: m[:2])
        top, ways = tree([m[1] for m in members])
        tops.append(top)
        found.append([(m[2], group, m[1], top, way) for m, way in zip(members, ways)])
    if not tops:
        return []
    root, upper = tree(tops)
    return sorted((
        (key, group, leaf, top, root, tuple(way + above)) for part, above in zip(found, upper) for key, group, leaf, top, way in part
    ), key=repr)


def ran(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    found = manifest.manifest(table).collect()
    return sorted((
        (r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.proof)) for r in found
    ), key=repr)


def test_directory_over_far_and_negative_ids(spark):
    ids = [0, 1, 63, 64, 65, 10**6, 10**12, 2**62, -1, -64, -(10**13), *range(3000, 3400)]
    rows = [(i, g, digest(f"{g}{i}")) for i in ids for g in ("a", "é", None) if i % 3 or g != "a"]
    assert ran(spark, rows) == brute(rows)


def test_more_leaves_than_one_array_holds(spark):
    rows = [(i * 7, "big" if i % 40 else "small", digest(str(i))) for i in range(2500)] + [(5, f"s{i}", digest(f"s{i}")) for i in range(300)]
    assert ran(spark, rows) == brute(rows)


def test_ties_null_ids_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES", 4)
    rows = [(None, "a", digest("x")), (None, "a", digest("y")), (7, "a", digest("z")), (8, "a", digest("w"))]
    rows += [(7, "a", digest("q"))] * 23 + [(7, None, digest(str(i))) for i in range(30)] + [(-(2**63), "a", digest("v"))]
    # A null id and the least number are one place: their leaves decide.
    assert ran(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark, odd_docs, no_docs):
    assert manifest.manifest(no_docs.withColumn("leaf", manifest.digest("text"))).count() == 0
    assert ran(spark, []) == []
    odd = odd_docs.selectExpr("*", "doc_id AS g", "text AS row", "'x' AS rank", "'y' AS root", "1 AS node", "2 AS slot", "3 AS word")
    found = manifest.manifest(odd.withColumn("leaf", manifest.digest("doc_id", "source", "lang", "n_chars", "text")))
    assert found.columns == [c for c in odd.columns if c != "root"] + ["leaf", "subroot", "root", "proof"]
    rows = found.collect()
    assert len(rows) == odd_docs.count() and len({r.root for r in rows}) == 1
    assert found.where(manifest.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == len(rows)


def test_fields_of_a_leaf(spark):
    row = spark.createDataFrame([(12, None, "é\n", "")], "a long, b string, c string, d string")
    assert row.select(manifest.digest("a", "b", "c", "d")).first()[0] == digest("2:12-3:é\n0:")


@pytest.mark.parametrize("count,change", [(1, False), (1, True), (4, False), (10, True)])
def test_fold_finds_a_change(spark, count, change):
    rows = [(i, "a", digest(str(i))) for i in range(count)]
    found = manifest.manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"))
    leaf = F.sha2(F.lit("other"), 256) if change else F.col("leaf")
    assert found.where(manifest.fold(leaf, F.col("proof")) == F.col("root")).count() == (0 if change else count)
