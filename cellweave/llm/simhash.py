"""SimHash near-duplicates: one-wildcard variants of fewer segments than bits may differ."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Words, in_turns, small_batches, stored
from .components import components
from .decontam import if_small

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
#: Buckets of up to so many values are compared by array expressions, larger ones in Python.
FEW = 16
#: Members of a variant's bucket that are compared in one task; larger buckets are cut into blocks.
BLOCK = 2048
SEED = 42


def _bits(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, the 64 bits set in over half of its hashes. rows: ascending."""
    out = np.zeros((n, BITS), np.int64)
    if len(hashes):
        for lo in range(0, len(hashes), 1 << 16):  # keeps the unpacked bits to a few MB
            part, of = hashes[lo:lo + (1 << 16)], rows[lo:lo + (1 << 16)]
            ones = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[cuts]] += np.add.reduceat(ones, cuts, axis=0, dtype=np.int64)
    total = np.bincount(rows, minlength=n)
    return np.packbits(out * 2 > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(text: Column) -> Column:
    """Column of 64-bit fingerprints of whole texts, as signed longs; see ``_fingerprints``."""

    def whole(texts: pa.Array) -> pa.Array:
        return in_turns(texts, _fingerprints)

    return arrow_udf(whole, "long")(text)


def _fingerprints(text: pa.Array) -> pa.Array:
    """SimHash of whole texts over lower-cased word shingles, repeats included, as a signed long.

    A text of fewer words has its whole sequence as one shingle; a null, empty or blank text has
    no shingle and the fingerprint zero.
    """
    words = Words(text)
    n, out, rows = len(words.at) - 1, [], []
    digest = xxhash.xxh64_intdigest
    counts = np.diff(words.first)
    # Words set side by side with one space between them, so that a shingle is one slice.
    sizes = words.end - words.start
    to = np.cumsum(sizes + 1)
    joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    at = to - sizes - 1
    shift = np.repeat(at - words.start, sizes)
    inside = np.arange(len(shift)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(words.start, sizes)
    joined[inside + shift] = words.data[inside]
    flat, first, last = joined.tobytes(), at, at + sizes
    shingles = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    begin = np.repeat(words.first[:-1], shingles) + (np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles))
    stop = np.minimum(begin + SHINGLE, np.repeat(words.first[1:], shingles)) - 1
    if len(begin):
        out = [digest(flat[a:b], SEED) for a, b in zip(first[begin].tolist(), last[stop].tolist())]
    rows = np.repeat(np.arange(n), shingles)
    return pa.array(_bits(np.array(out, np.uint64), rows, n).view(np.int64), pa.int64())


def segments(max_distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """(lowest bit, length) of so few segments that one of them differs by at most one bit.

    With s segments and d differing bits, some segment has at most d // s of them.
    """
    count = max_distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _forest(values: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links within ``max_distance`` connect: at most one fewer than values."""
    root = np.arange(len(values))
    found = []
    for i in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= max_distance)
        if len(near):
            # One edge for each component that the value touches.
            tops, where = np.unique(root[near], return_index=True)
            found += [(int(values[near[j]]), int(values[i])) for j in where]
            root[np.isin(root[:i + 1], tops).nonzero()[0]] = i
            root[i] = i
    return found


def _linker(max_distance: int):
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def linked(members: pa.Array) -> pa.Array:
        out = []
        for row in members:
            values = np.unique(row.values.to_numpy(zero_copy_only=False).view(np.int64)).view(np.uint64)
            edges = np.array(_forest(values, max_distance), np.uint64).reshape(-1, 2).view(np.int64)
            out.append([{"a": a, "b": b} for a, b in edges.tolist()])
        return pa.array(out, kind)

    return arrow_udf(linked, "array<struct<a:long,b:long>>")


def _few(members: str, max_distance: int) -> Column:
    """All links among the values of a small array."""
    return F.flatten(F.transform(members, lambda x, i: F.transform(
        F.filter(F.slice(members, i + 2, F.lit(FEW)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= max_distance),
        lambda y: F.struct(x.alias("a"), y.alias("b")),
    )))


def links(values: DataFrame, column: str = "fp", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct 64-bit values whose components are those of all pairs that
    differ in at most ``max_distance`` bits. Nulls are left out.

    Every value is indexed under each of its segments with one bit masked; values with an equal
    variant meet and are compared. A bucket of more than ``BLOCK`` values, known from counts of
    the unmasked segments, is cut into blocks and each pair of blocks meets in a group of its own,
    so a group is bounded and no pair is left out. Each group returns a spanning forest, never all
    pairs.
    """
    fps = values.where(F.col(column).isNotNull()).select(F.col(column).alias("fp")).distinct()
    cuts = segments(max_distance)
    whole = [
        F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(2**n - 1).cast("long")).alias("part"))
        for s, (lo, n) in enumerate(cuts)
    ]
    full = (
        fps.select(F.inline(F.array(*whole))).groupBy("seg", "part").count().where(f"count > {BLOCK // 2}")
    )

    def masked(part: str, s: int) -> list:
        # The key holds the segment's masked bits and, above them, which bit of 64 is masked.
        lo, n = cuts[s]
        return [
            F.col(part).bitwiseAND(F.lit(2**n - 1 - 2**i).cast("long")).bitwiseOR(F.lit((lo + i) << 32).cast("long"))
            for i in range(n)
        ]

    hot = None
    for s in range(len(cuts)):
        keys = full.where(F.col("seg") == s).select(F.explode(F.array(*masked("part", s))).alias("key"), "count")
        hot = keys if hot is None else hot.union(keys)
    hot = hot.groupBy("key").agg(F.sum("count").alias("n")).where(f"n > {BLOCK}").select(
        "key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("m"),
    )
    parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(2**n - 1).cast("long")).alias(f"p{s}") for s, (lo, n) in enumerate(cuts)]
    keys = F.concat(*[F.array(*masked(f"p{s}", s)) for s in range(len(cuts))])
    variants = fps.select("fp", *parts).select("fp", F.explode(keys).alias("key"))
    block = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    placed = (
        variants.join(hot, "key", "left")
        .withColumn("own", F.when(F.col("m").isNull(), F.lit(0)).otherwise(block))
        .withColumn("other", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
    )
    buckets = (
        placed.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        .withColumn("near", F.when(F.size("members") <= FEW, _few("members", max_distance)))
        .where("near is null or size(near) > 0")
        .select("near", F.when(F.col("near").isNull(), F.col("members")).alias("members"))
    )
    # Most buckets hold a few values that met by chance; what is left of them is written.
    left = stored(buckets, "buckets")
    small = left.where("near is not null").select(F.inline("near"))
    return small.union(left.where("members is not null").select(F.inline(_linker(max_distance)("members")))).distinct()


def _classed(docs: DataFrame, doc_id: str, text: str, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, h) of the documents with a hash of their text, and (fp, root, component_id) of
    the fingerprints; both stored, so that a common one can be split by the adaptive join."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    prints = stored(small_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"), h.alias("h")), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints)).select(F.col("node").alias("fp"), "root")
    classes = stored(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    top = stored(classes.groupBy("root").agg(F.min("least").alias("component_id")), "top")
    return prints, stored(classes.join(top, "root").select("fp", "root", "component_id"), "roots")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``docs``.

    Documents link if their fingerprints differ in at most ``max_distance`` bits; component_id is
    the smallest id that links reach, itself included. Null ids are kept and never chosen (null if
    a component has no other); null and empty texts have fingerprint zero and link like any other;
    repeated rows stay repeated; an empty table gives no rows. Other columns are not read.
    """
    prints, classes = _classed(docs, doc_id, text, max_distance)
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that of the smallest id (null last).

    Rows are told apart by id and text together: if an id stands in several components, it stays in
    each where it is the smallest. Of equal rows one stays.
    """
    prints, classes = _classed(docs, doc_id, text, max_distance)
    rows = prints.join(classes, "fp", "left").select("doc_id", "h", "root")
    kept_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m")
    firsts = stored(rows.groupBy("root").agg(kept_row).select(F.col("root").alias("of"), F.col("m.doc_id").alias("__id"), F.col("m.h").alias("__kept")), "firsts")
    other = ~(F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__kept")))
    gone = stored(rows.join(firsts, F.col("root") == F.col("of")).where(other).select(F.col("doc_id").alias("__gone"), F.col("h").alias("__text")).distinct(), "gone")
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = hashed.join(if_small(gone), F.col(doc_id).eqNullSafe(F.col("__gone")) & (F.col("__h") == F.col("__text")), "left_anti")
    twice = stored(prints.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("__twice"), F.col("h").alias("__of")), "twice")
    names = [F.col(c) for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*names)
    again = F.col(doc_id).eqNullSafe(F.col("__twice")) & (F.col("__h") == F.col("__of"))
    one = kept.join(twice, again, "left_semi").dropDuplicates([doc_id, "__h"])
    return kept.join(twice, again, "left_anti").select(*names).unionByName(one.select(*names))
