"""Prefix trie of conversations by truncation peeling.

A conversation is the array of keys of its prefixes. Conversations that end with equal turns are
one node from the start. From the deepest depth upwards, nodes that survive are cut back to it,
meet those conversations that end there, and are grouped again by the key of what is left; counts
of a subtree are sums of what arrives, so nodes are found and totalled in the same pass.

Between two depths at which its members change a node's path is a chain: nothing joins it, so it is
stripped in one step. How many conversations share each prefix tells where that is; without it the
longest conversation would decide the number of rounds. With it they are at most as many as turns
in the longest prefix that different conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import discard, mix, small_batches, stored
from .decontam import if_small

#: Conversations in one piece of a list of ids at most.
PIECE = 4096
WALK = "struct<keys:array<binary>,sums:array<long>>"
_WALK = pa.struct([("keys", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
_BLANK = b""


def walks(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turns): each conversation's turns in order as (a, b, n): two digests of role and
    text, and the text's code points. Turns are ordered by ``turn``, null first, those of one number
    by their digests. Null roles and texts are empty; rows without a conversation's id are in none.

    Texts do not move; a conversation's turns are one array of 24 bytes a turn.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.struct(
            F.col(turn).alias("turn"), F.xxhash64(by, said).alias("a"), F.xxhash64(F.lit(7), said, F.lit(1), by).alias("b"),
            F.length(said).cast("long").alias("n"),
        ).alias("x"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n")))
    return turns.groupBy("conv").agg(ordered.alias("turns"))


def _prefixes(turns: pa.Array) -> pa.Array:
    ends = turns.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    flat = turns.flatten()
    a, b, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
    size = np.diff(ends)
    place = np.arange(len(a), dtype=np.int64) - np.repeat(ends[:-1], size)
    salt = mix((place + 1).astype(np.uint64))

    def running(x: np.ndarray) -> np.ndarray:
        total = np.append(np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype))
        return total[1:] - np.repeat(total[ends[:-1]], size)

    # A prefix's key is a sum over its turns of digests mixed with their places, modulo 2**128.
    pair = np.stack([running(mix(x.view(np.uint64) ^ salt)) for x in (a, b)], axis=1)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(np.ascontiguousarray(pair).tobytes())])
    at = pa.array(ends, pa.int32())
    keys = pa.ListArray.from_arrays(at, raw.cast(pa.binary()))
    return pa.StructArray.from_arrays([keys, pa.ListArray.from_arrays(at, pa.array(running(n.astype(np.int64))))], fields=list(_WALK))


def _at(array: str, depth) -> Column:
    """Element ``depth`` of a prefix array, the root's if zero."""
    none = F.lit(_BLANK) if array == "keys" else F.lit(0).cast("long")
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.get(array, (depth - 1).cast("int"))).otherwise(none)


def _meeting(depth: Column) -> Column:
    """The next depth above ``depth`` at which others join or leave the path of a node of ``n``
    members: the numbers in ``shared`` fall with the depth."""
    above = F.filter(F.slice("shared", F.lit(1), F.greatest(depth - 1, F.lit(0)).cast("int")), lambda x: x > F.col("n"))
    return F.size(above)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order, with commas between."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    for batch in batches:
        done = []
        for k, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist()):
            if state is not None and k == key:
                state.update(b"," + piece.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends"])
    if state is not None:
        yield row()


def _endings(convs: DataFrame) -> DataFrame:
    """(key, ends): digest of the ids of the conversations that end at each key, ascending. Ids are
    joined into pieces where they stand; a key's pieces pass one task one by one."""
    pieces = convs.groupBy("key", F.floor(F.col("conv") / PIECE).alias("piece_no")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("piece"),
    )
    return pieces.repartition("key").sortWithinPartitions("key", "piece_no").select("key", "piece").mapInArrow(_digests, "key binary, ends string")


def trie(walked: DataFrame) -> DataFrame:
    """Nodes of the trie of ``walked`` (conv, turns), one row for each distinct run of first turns.

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    the smallest conversation below a node, its depth, the parent's smallest conversation (null at
    the root), how many conversations start with it, its children, the childless nodes below it,
    the code points that its subtree's turns share ((n_convs - 1) times each node's last turn), and
    the SHA-256 of the ids that end at it. Conversations without turns end at the root. Without any
    conversation there are no rows.
    """
    walk = arrow_udf(_prefixes, WALK)("turns")
    paths = stored(small_batches(walked).select("conv", walk.alias("w")).select("conv", "w.keys", "w.sums"), "paths")
    steps = paths.select("conv", F.posexplode("keys").alias("at", "key"))
    common = stored(steps.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
    shared = steps.join(common, "key").groupBy("conv").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("shared"),
    )
    full = stored(paths.join(stored(shared, "shared"), "conv", "left").select(
        "conv", "keys", "sums", F.coalesce("shared", F.expr("CAST(array() AS array<long>)")).alias("shared"),
        F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(_BLANK)).alias("key"),
    ), "full")
    discard(common)
    discard(paths)
    ends = stored(_endings(full.select("key", "conv")), "ends")
    kept = [F.first(c).alias(c) for c in ("keys", "sums", "shared")]
    classes = full.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), *kept)
    depth = F.size("keys")
    passed = (depth == 0) | (F.coalesce(F.get("shared", depth - 1), F.lit(1)) > F.col("n"))
    classes = stored(classes.select(
        "key", "conv", "n", "keys", "sums", "shared", depth.alias("depth"), passed.alias("passed"),
        F.lit(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        F.when(depth > 0, (F.col("n") - 1) * (_at("sums", depth) - _at("sums", depth - 1))).otherwise(F.lit(0)).alias("saved"),
        F.when(~passed, _meeting(depth)).alias("up"),
    ), "classes")
    # Depths at which nodes meet, the root's always.
    falls = F.filter(F.sequence(F.lit(1), F.size("shared")), lambda d: F.coalesce(F.get("shared", d), F.lit(1)) < F.get("shared", d - 1))
    meet = classes.select(F.explode(F.when(F.size("shared") > 0, falls)).alias("d")).union(classes.where("passed").select("depth")).distinct()
    depths = sorted({0, *(r[0] for r in meet.collect())}, reverse=True)
    if classes.isEmpty():
        depths = []
    nodes, met = [classes.where("not passed")], []
    for d in depths:
        arrived = reduce(DataFrame.unionByName, [
            *(t.where(F.col("up") == d).withColumn("child", F.lit(1)) for t in nodes),
            classes.where(F.col("passed") & (F.col("depth") == d)).withColumn("leaves", F.lit(0).cast("long"))
            .withColumn("saved", F.lit(0).cast("long")).withColumn("child", F.lit(0)),
        ])
        # The chain between an arrival and this depth, less the arrival itself.
        chain = F.when(F.col("child") == 1, (F.col("n") - 1) * (_at("sums", F.col("depth") - 1) - _at("sums", d))).otherwise(F.lit(0))
        group = arrived.select(
            _at("keys", d).alias("key"), "conv", "n", "leaves", (F.col("saved") + chain).alias("saved"), "child",
            *[F.slice(c, 1, d).alias(c) for c in ("keys", "sums", "shared")],
        ).groupBy("key").agg(
            F.min("conv").alias("conv"), F.sum("n").alias("n"), *kept, F.sum("child").alias("children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        )
        own = (F.col("n") - 1) * (_at("sums", d) - _at("sums", d - 1)) if d else F.lit(0)
        found = stored(group.select(
            "key", "conv", "n", "keys", "sums", "shared", F.lit(d).alias("depth"), F.lit(False).alias("passed"), "children",
            # A node at which every conversation ends is itself a childless one.
            F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("saved") + own).alias("saved"),
            (_meeting(F.lit(d)) if d else F.lit(None).cast("int")).alias("up"),
        ), "met")
        nodes.append(found)
        met.append(found.select("key", "conv"))
    tops = reduce(DataFrame.unionByName, nodes)
    parents = [t.select(F.col("key").alias("_up_key"), F.col("conv").alias("_up_conv")) for t in met]
    parents = stored(reduce(DataFrame.unionByName, parents), "parents") if parents else None
    if parents is None:
        parents = tops.limit(0).select(F.col("key").alias("_up_key"), F.col("conv").alias("_up_conv"))
    ended = ends.select(F.col("key").alias("_end_key"), "ends")
    segments = stored(tops.withColumn("_up", F.when(F.col("up").isNotNull(), _at("keys", F.col("up")))), "segments")
    joined = (
        segments.join(if_small(parents), F.col("_up") == F.col("_up_key"), "left")
        .join(if_small(ended), F.col("key") == F.col("_end_key"), "left")
    )
    at = F.explode(F.sequence(F.coalesce(F.col("up"), F.lit(-1)) + 1, F.col("depth"))).alias("at")
    spread = joined.select("*", at)
    last = F.col("at") == F.col("depth")
    below = (F.col("n") - 1) * (_at("sums", F.col("depth") - 1) - _at("sums", F.col("at") - 1))
    return spread.select(
        F.col("conv").alias("conv_id"), F.col("at").cast("long").alias("depth"),
        F.when(F.col("at") == F.coalesce(F.col("up"), F.lit(-1)) + 1, F.col("_up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.when(last, F.col("saved")).otherwise(F.col("saved") + below).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.sha2(F.lit(_BLANK), 256))).otherwise(F.sha2(F.lit(_BLANK), 256)).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``trie`` of a table of turns; other columns are not read and repeated rows are further turns."""
    return trie(walks(conversations, conv_id, turn, role, text))


def with_heads(walked: DataFrame, every: int, most: int) -> DataFrame:
    """``walked`` after the first h turns of each conversation c were replaced by the first h of
    conversation c - c % ``every``, as far as there are any; h is the CRC-32 of c modulo ``most``."""
    base = F.col("conv") - F.col("conv") % every
    heads = walked.where(F.col("conv") % every == 0).select(F.col("conv").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    joined = walked.withColumn("_of", base).join(if_small(stored(heads, "heads")), F.col("_of") == F.col("_base"), "left").withColumn("_h", h)
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return joined.select("conv", F.concat(F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0)), own).alias("turns"))
