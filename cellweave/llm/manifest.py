"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, trees from keyed slot arrays.

Each group's ids become a compressed bitmap: one 64-bit word for every 64 ids of which the group
holds some. Partial bitmaps are merged by OR, a directory of population counts gives each word its
base, and a leaf's coordinate is that base plus the bits below its own: no leaves are sorted. A
leaf then goes to slot ``rank mod SLOTS`` of array ``rank div SLOTS``, and every array is reduced by
LEVELS levels at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import small_batches, stored
from .decontam import if_small

FANOUT = 3
#: Levels that one slot array is reduced by, and its slots.
LEVELS = 5
SLOTS = FANOUT**LEVELS
#: Bits by which the directory's levels differ: a window of it has at most 2**16 rows.
DIRECTORY_BITS = 16
#: Rows that one task makes of a leaf that is repeated.
COPIES = 4096
PROOF = "array<struct<left:string,right:string>>"


def field(column: str) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: str) -> Column:
    """Digest of a row's fields, as lowercase hex."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(proof, leaf, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings on a leaf's way, level by level and left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


# --- coordinates ---------------------------------------------------------------------------


def _directory(words: DataFrame) -> DataFrame:
    """(g, word, bits, base): the rows of the same group in smaller words. A level of the directory
    sums within windows of 2**DIRECTORY_BITS words; the next one above sums those windows."""
    low, high = words.agg(F.min("word"), F.max("word")).first()
    levels, shift = [words.select("g", F.col("word").alias("at"), "n")], 0
    while low is not None and low >> shift + DIRECTORY_BITS != high >> shift + DIRECTORY_BITS:
        shift += DIRECTORY_BITS
        levels.append(levels[-1].groupBy("g", F.shiftright("at", DIRECTORY_BITS).alias("at")).agg(F.sum("n").alias("n")))
    base = None
    for level in reversed(levels):
        part = level.withColumn("up", F.shiftright("at", DIRECTORY_BITS))
        before = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if base is not None:
            above = base.select(F.col("g").alias("_g"), F.col("at").alias("_up"), F.col("base").alias("_base"))
            part = part.join(above, F.col("g").eqNullSafe(F.col("_g")) & (F.col("up") == F.col("_up")))
            part = part.withColumn("base", F.col("base") + F.col("_base"))
        base = part.select("g", "at", "base")
    bases = base.select(F.col("g").alias("_g"), "at", "base")
    return words.join(bases, F.col("g").eqNullSafe(F.col("_g")) & (F.col("word") == F.col("at"))).select("g", "word", "bits", "base")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, key, leaf, row) with ``rank``: place in its group by key, from zero.

    Rows of one key are ordered by their leaf. They are told from single ones by the bitmap, whose
    population is then less than its rows.
    """
    # Words count from the least long, so that they are never negative.
    placed = leaves.withColumn("word", F.shiftright("key", 6) + F.lit(1 << 57)).withColumn("bit", F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    words = stored(
        placed.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")), "words",
    )
    directory = stored(_directory(words), "directory")
    found = if_small(directory.select(F.col("g").alias("_g"), F.col("word").alias("_word"), "bits", "base"))
    if words.where("n > bit_count(bits)").isEmpty():
        below = F.when(F.col("bit") == 0, F.lit(0)).otherwise(F.expr("bit_count(shiftleft(bits, 64 - bit))"))
        ranked = placed.join(found, F.col("g").eqNullSafe(F.col("_g")) & (F.col("word") == F.col("_word")))
        return ranked.withColumn("rank", F.col("base") + below).select("g", "key", "leaf", "row", "rank")
    # Repeated rows are counted before they move; rows of one key are split by their leaf's first digits.
    ones = stored(
        placed.groupBy("g", "word", "bit", "key", "leaf", "row").agg(F.count("*").alias("copies"))
        .withColumn("sub", F.substring("leaf", 1, 4)), "ones",
    )

    def before(table: DataFrame, within: list[str], by: list, name: str) -> DataFrame:
        window = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumn(name, F.coalesce(F.sum("copies").over(window), F.lit(0)))

    subs = ones.groupBy("g", "word", "key", "sub").agg(F.sum("copies").alias("copies"))
    keys = subs.groupBy("g", "word", "key").agg(F.sum("copies").alias("copies"))
    subs = before(subs, ["g", "word", "key"], ["sub"], "of_sub").select("g", "key", "sub", "of_sub")
    keys = before(keys, ["g", "word"], ["key"], "of_key").select("g", "key", "of_key")
    own = before(ones, ["g", "key", "sub"], ["leaf", F.to_json("row")], "of_row")

    def same(table: DataFrame, names: list[str]) -> Column:
        on = own["g"].eqNullSafe(table["g"])
        for name in names:
            on = on & (own[name] == table[name])
        return on

    subs, keys = stored(subs, "subs"), stored(keys, "keys")
    ranked = (
        stored(own, "own").select("g", "word", "key", "sub", "leaf", "row", "copies", "of_row")
        .join(subs.withColumnsRenamed({"g": "_sg", "key": "_sk", "sub": "_ss"}), F.expr("g <=> _sg AND key = _sk AND sub = _ss"))
        .join(keys.withColumnsRenamed({"g": "_kg", "key": "_kk"}), F.expr("g <=> _kg AND key = _kk"))
        .join(found, F.col("g").eqNullSafe(F.col("_g")) & (F.col("word") == F.col("_word")))
        .withColumn("rank", F.col("base") + F.col("of_key") + F.col("of_sub") + F.col("of_row"))
        .select("g", "key", "leaf", "row", "rank", "copies")
    )
    slices = ranked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((copies - 1) div {COPIES} AS INT)"))))
    copy = F.explode(F.sequence(F.lit(0), F.least(F.lit(COPIES - 1), F.col("copies") - 1 - F.col("slice") * COPIES).cast("int")))
    spread = slices.repartition("g", "key", "slice").withColumn("copy", copy)
    return spread.withColumn("rank", F.col("rank") + F.col("slice") * COPIES + F.col("copy")).select("g", "key", "leaf", "row", "rank")


# --- trees ---------------------------------------------------------------------------------


def reduced(digests: list[str], levels: int | None) -> tuple[str, list[list[str]]]:
    """The node above ``digests`` and all levels below it; ``levels`` None: until one node remains."""
    rows = [digests]
    while len(rows[-1]) > 1 if levels is None else len(rows) <= levels:
        last = rows[-1]
        rows.append([hashlib.sha256("".join(last[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)])
    return rows[-1][0], rows[:-1]


def steps(rows: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """Left and right siblings of a slot on each level."""
    out = []
    for row in rows:
        first = slot - slot % FANOUT
        out.append(("".join(row[first:slot]), "".join(row[slot + 1:first + FANOUT])))
        slot //= FANOUT
    return out


def _in_slots(slots: pa.StructArray) -> tuple[list[int], list[str]]:
    """Each entry's slot and the leaves set into their slots."""
    at = slots.field("slot").to_pylist()
    digests = [""] * len(at)
    for s, leaf in zip(at, slots.field("leaf").to_pylist()):
        digests[s] = leaf
    return at, digests


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = []
        for slots, whole in zip(batch["slots"], batch["whole"].to_pylist()):
            tops.append(reduced(_in_slots(slots.values)[1], None if whole else LEVELS)[0])
        yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], pa.array(tops, pa.string())], ["g", "block", "leaf"])


def _prover(schema: pa.Schema):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper = batch["upper"].to_pylist() if "upper" in batch.schema.names else [[]] * batch.num_rows
            for i, whole in enumerate(batch["whole"].to_pylist()):
                slots = batch["slots"][i].values
                at, digests = _in_slots(slots)
                rows = reduced(digests, None if whole else LEVELS)[1]
                above = [(x["left"], x["right"]) for x in upper[i] or []]
                pairs, ends = [], [0]
                for s in at:
                    pairs += steps(rows, s) + above
                    ends.append(len(pairs))
                proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["left", "right"],
                ))
                n = len(at)
                same = {c: pa.repeat(batch[c][i], n) for c in ("g", "block", "node")}
                cells = {**same, "slot": slots.field("slot"), "leaf": slots.field("leaf"), "row": slots.field("row"), "proof": proof}
                yield pa.RecordBatch.from_arrays([cells[f.name].cast(f.type) for f in schema], schema=schema)

    return prove


def _blocks(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Slot arrays (g, block, whole, slots); ``whole``: the group has no other array."""
    arrays = nodes.select(
        "g", F.expr(f"rank div {SLOTS}").alias("block"), F.struct(F.expr(f"CAST(rank % {SLOTS} AS INT)").alias("slot"), "leaf", "row").alias("x"),
    ).groupBy("g", "block").agg(F.collect_list("x").alias("slots"))
    small = if_small(counts.select(F.col("g").alias("_g"), "n"))
    return arrays.join(small, F.col("g").eqNullSafe(F.col("_g"))).select("g", "block", (F.col("n") <= SLOTS).alias("whole"), "slots")


def _tree(nodes: DataFrame, upper: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(g, leaf) with the top node of every group, and the slot arrays of each round.

    ``nodes``: (g, rank, leaf, row). Each round divides the nodes by SLOTS.
    """
    rounds = []
    counts = stored(nodes.groupBy("g").agg((F.max("rank") + 1).alias("n")), "counts")
    while True:
        blocks = stored(_blocks(nodes, counts), "slots")
        rounds.append(blocks)
        tops = stored(small_batches(blocks.select("g", "block", "whole", "slots")).mapInArrow(
            _top, f"g {dict(blocks.dtypes)['g']}, block long, leaf string",
        ), "tops")
        if blocks.where("not whole").isEmpty():
            return tops.select("g", "leaf"), rounds
        # Groups that are done stay as one node, which the next round leaves as it is.
        nodes = tops.select("g", F.col("block").alias("rank"), "leaf", F.lit(None).cast("string").alias("row"))
        counts = stored(counts.select("g", F.expr(f"(n + {SLOTS - 1}) div {SLOTS}").alias("n")), "counts")


def _proofs(rounds: list[DataFrame], tops: DataFrame, way: DataFrame | None = None) -> DataFrame:
    """(g, leaf, row, node, proof) of every leaf of the first round; node: its group's top.

    ``way``: (g, upper) with the steps above each group's top.
    """
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k]
        if above is None:
            names = tops.select(F.col("g").alias("_g"), F.col("leaf").alias("node"))
            if way is not None:
                ways = way.select(F.col("g").alias("_wg"), "upper")
                names = names.join(ways, F.col("_g").eqNullSafe(F.col("_wg"))).drop("_wg")
            blocks = blocks.join(if_small(stored(names, "names")), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        else:
            blocks = blocks.join(above, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_rank"))).drop("_g", "_rank")
        row = blocks.schema["slots"].dataType.elementType["row"].dataType.simpleString()
        shape = StructType.fromDDL(
            f"g {dict(blocks.dtypes)['g']}, block long, slot int, leaf string, row {row}, node string, proof {PROOF}",
        )
        found = small_batches(blocks).mapInArrow(_prover(to_arrow_schema(shape)), shape)
        if k:
            above = stored(found.select(
                F.col("g").alias("_g"), (F.col("block") * SLOTS + F.col("slot")).alias("_rank"), "node", F.col("proof").alias("upper"),
            ), "above")
    return found.select("g", "leaf", "row", "node", "proof")


def in_order(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``rank``, the place of each row by ``column`` (null first), from zero. Ranges
    of the column are sorted apart and only their sizes are added up."""
    ranged = values.sort(F.col(column).asc_nulls_first()).withColumn("_range", F.spark_partition_id())
    placed = stored(ranged, "ranged")
    sizes = placed.groupBy("_range").count()
    start = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(start), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(F.col(column).asc_nulls_first())
    numbered = placed.withColumn("_n", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), F.col("_range") == F.col("_r")).select(
        *[F.col(c) for c in values.columns], (F.col("_start") + F.col("_n")).cast("long").alias("rank"),
    )


def manifest(table: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf") -> DataFrame:
    """``table`` with subroot, root and proof: a tree per group over the rows' leaves in the order of
    their keys, and a tree over the groups' tops in the order of the groups.

    ``leaf`` holds a digest as lowercase hex, ``key`` whole numbers. Runs of FANOUT nodes are hashed
    together while a group has several; proof lists the siblings on the way from the leaf to the root
    (``fold`` follows it). A null key is taken for the least number; rows of one key are ordered by
    their leaves, equal rows stay repeated and each has a place of its own; a null group is the first
    one. An empty table gives no rows. Columns of any name are carried along, but those of the three
    added names are replaced.
    """
    added = ("subroot", "root", "proof")
    names = [c for c in table.columns if c not in added]
    plain = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    leaves = stored(table.select(
        F.col(group).alias("g"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), F.col(leaf).alias("leaf"), plain.alias("row"),
    ), "leaves")
    nodes = coordinates(leaves).select("g", "rank", "leaf", "row")
    tops, rounds = _tree(stored(nodes, "nodes"))
    groups = in_order(tops, "g")
    roots, upper = _tree(stored(groups.select(F.lit(0).alias("g"), "rank", "leaf", F.struct("g").alias("row")), "groups"))
    way = _proofs(upper, roots).select(F.col("row.g").alias("g"), F.col("proof").alias("upper"), F.col("node").alias("root"))
    way = stored(way, "way")
    found = _proofs(rounds, tops, way)
    root = way.select("root").first()
    return found.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], F.col("node").alias("subroot"),
        F.lit(root and root[0]).cast("string").alias("root"), "proof",
    )
