"""WARC records and Merkle fixity audit of replicas.

A file's records are hashed, and ordered ranges of its byte offsets are hashed into a tree: a leaf
covers LEAF_BYTES of offsets, a node FANOUT children. Two replicas with equal roots need no further
look; otherwise the audit descends, level by level, only below nodes that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .decontam import if_small

LEAF_BYTES = 16 << 10
FANOUT = 16
OK, CORRUPT, MOVED, MISSING, EXTRA = "ok", "corrupt", "moved", "missing", "extra"


def records(pages: DataFrame, file: Column, record_id: Column, uri: str = "url", body: str = "html") -> DataFrame:
    """(file, record_id, offset, length, record): a WARC 1.1 resource record of each row.

    Records stand in their file in order of id, then of their bytes; ``file`` must bound the rows
    of a file, as writing one does. Null uris and bodies are empty; repeated rows are records of
    their own.
    """
    made = pages.select(file.alias("file"), record_id.alias("record_id"), _record(uri, body).alias("record"))
    light = made.withColumn("length", F.octet_length("record").cast("long")).withColumn("tie", F.xxhash64("record"))
    return light.withColumn("offset", _offset()).select("file", "record_id", "offset", "length", "record")


def _record(uri: str, body: str) -> Column:
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col(uri), F.lit(""))),
        F.lit("Content-Type: text/html"), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(payload, 256)),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")), F.lit("\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), payload, F.lit(b"\r\n\r\n"))


def _offset() -> Column:
    order = Window.partitionBy("file").orderBy("record_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(order), F.lit(0))


def index(
    pages: DataFrame, file: Column, record_id: Column, uri: str = "url", body: str = "html", kept: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(file, record_id, offset, length, digest) of the records that ``records`` writes.

    Records are hashed where their rows are: only digests and lengths are moved and put in order.
    ``kept`` gives the bytes that stand in the place of a record (damaged ones, say) from the record;
    it may use its record_id.
    """
    made = pages.select(file.alias("file"), record_id.alias("record_id"), _record(uri, body).alias("record"))
    stands = F.col("record") if kept is None else kept(F.col("record"))
    light = made.select(
        "file", "record_id", F.octet_length("record").cast("long").alias("length"), F.xxhash64("record").alias("tie"),
        F.sha2(stands, 256).alias("digest"), F.octet_length(stands).cast("long").alias("kept_length"),
    )
    return light.withColumn("offset", _offset()).select("file", "record_id", "offset", F.col("kept_length").alias("length"), "digest")


def hashed(replica: DataFrame) -> DataFrame:
    """(file, record_id, offset, length, digest) of a replica's records, which may be hashed already."""
    if "record" not in replica.columns:
        return replica.select("file", "record_id", "offset", "length", "digest")
    return replica.select("file", "record_id", "offset", "length", F.sha2("record", 256).alias("digest"))


def tree(leaves: DataFrame) -> tuple[list[DataFrame], int]:
    """Levels (file, node, digest) from the leaf ranges up to one root for each file, and their number.

    ``leaves``: rows of ``hashed``. A record belongs to the leaf in which it begins. A node's digest
    is of its members' digests in order, each with its place, so a shifted record changes it. A
    leaf holds at most LEAF_BYTES records and a node FANOUT children, however large a file is.
    """
    member = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), "digest")
    level = leaves.select("file", F.floor(F.col("offset") / LEAF_BYTES).alias("node"), member.alias("m"))
    levels = [_joined(level)]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top:
        below = levels[-1].select(
            "file", F.floor(F.col("node") / FANOUT).alias("node"),
            F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "digest").alias("m"),
        )
        levels.append(_joined(below))
        top //= FANOUT
    return levels, len(levels)


def _joined(members: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("m")), "\n").cast("binary"), 256)
    return stored(members.groupBy("file", "node").agg(digest.alias("digest")), "nodes")


def audit(replica: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (file, record_id, offset, length, digest, status, level), one per record of either replica.

    ``replica`` is the reference. status: ok; moved (equal bytes at another offset); corrupt (the
    record is there with other bytes); missing (only in the reference); extra (only in the other,
    with its offset). level is where the descent ended: the number of levels above the leaves if
    the root agreed, less for each level that had to be opened, -1 for records looked at one by
    one. Replicas have the columns file, record_id, offset, length and record, or digest. Null files and ids are
    names like any other; records that repeat an id in a file are compared in order of offset; an
    empty replica leaves every record of the other missing or extra.
    """
    mine, theirs = stored(hashed(replica), "records"), stored(hashed(other), "records")
    (a, depth), (b, more) = tree(mine), tree(theirs)
    # The lower tree gets roots above its own, so that both have equally many levels.
    levels = max(depth, more)
    while len(a) < levels:
        a.append(_raised(a[-1]))
    while len(b) < levels:
        b.append(_raised(b[-1]))
    open_, ended = None, None
    for i in range(levels - 1, -1, -1):
        x, y = (t if open_ is None else _below(t, open_) for t in (a[i], b[i]))
        both = x.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("d")).join(
            y.select(F.col("file").alias("f2"), F.col("node").alias("n2"), F.col("digest").alias("d2")),
            F.col("f").eqNullSafe(F.col("f2")) & (F.col("n") == F.col("n2")), "full",
        )
        named = both.select(
            F.when(F.col("n").isNull(), F.col("f2")).otherwise(F.col("f")).alias("file"), F.coalesce("n", "n2").alias("node"),
            F.coalesce(F.col("d") == F.col("d2"), F.lit(False)).alias("equal"),
        )
        named = stored(named, "compared")
        same = named.where("equal").select("file", (F.col("node") * FANOUT**i).alias("first"), (F.col("node") * FANOUT**i + FANOUT**i).alias("stop"), F.lit(i).alias("level"))
        ended = same if ended is None else ended.union(same)
        open_ = named.where("not equal").select("file", "node")
    for t in (*a, *b):
        discard(t)
    # Leaves that differ: their records are compared one by one.
    bad = if_small(open_.select(F.col("file").alias("bf"), F.col("node").alias("bn")))
    leaf = F.floor(F.col("offset") / LEAF_BYTES)
    opened = [t.join(bad, F.col("file").eqNullSafe(F.col("bf")) & (leaf == F.col("bn")), "left_semi") for t in (mine, theirs)]
    nth = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset"))
    p, q = (t.withColumn("nth", nth) for t in opened)
    q = q.select(*[F.col(c).alias(f"o_{c}") for c in q.columns])
    one = p.join(
        q, F.col("file").eqNullSafe(F.col("o_file")) & F.col("record_id").eqNullSafe(F.col("o_record_id")) & (F.col("nth") == F.col("o_nth")), "full",
    )
    status = (
        F.when(F.col("o_nth").isNull(), F.lit(MISSING)).when(F.col("nth").isNull(), F.lit(EXTRA))
        .when(F.col("digest") != F.col("o_digest"), F.lit(CORRUPT)).when(F.col("offset") != F.col("o_offset"), F.lit(MOVED)).otherwise(F.lit(OK))
    )
    picked = [F.when(F.col("nth").isNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("file", "record_id", "offset", "length", "digest")]
    single = one.select(*picked, status.alias("status"), F.lit(-1).alias("level"))
    # All other records of the reference lie under a node that agreed, at one level exactly.
    clear = None
    for i in range(levels):
        ranges = ended.where(F.col("level") == i).select(F.col("file").alias("cf"), F.floor(F.col("first") / FANOUT**i).alias("cn"))
        at = F.floor(leaf / FANOUT**i)
        part = mine.join(ranges, F.col("file").eqNullSafe(F.col("cf")) & (at == F.col("cn")), "left_semi").select(
            "file", "record_id", "offset", "length", "digest", F.lit(OK).alias("status"), F.lit(i).alias("level"),
        )
        clear = part if clear is None else clear.union(part)
    return single.union(clear)


def _raised(level: DataFrame) -> DataFrame:
    return _joined(level.select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.concat_ws(
        ":", F.lpad(F.col("node").cast("string"), 20, "0"), "digest",
    ).alias("m")))


def _below(level: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes whose parent differed."""
    p = if_small(parents.select(F.col("file").alias("pf"), F.col("node").alias("pn")))
    return level.join(p, F.col("file").eqNullSafe(F.col("pf")) & (F.floor(F.col("node") / FANOUT) == F.col("pn")), "left_semi")
