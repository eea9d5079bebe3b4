import hashlib

from pyspark.sql import functions as F

from cellweave.llm import warc


def files(spark, records):
    """(file, id, bytes) rows laid one after another in each file."""
    out, at = [], {}
    for f, i, body in records:
        out.append((f, i, at.get(f, 0), len(body), bytearray(body), "x"))
        at[f] = at.get(f, 0) + len(body)
    return spark.createDataFrame(out, "file string, record_id long, offset long, length long, record binary, level string")


def states(a, b):
    return {(r["file"], r["record_id"], r["offset"]): r["status"] for r in warc.audit(a, b).collect()}


def body(i):
    return (f"record {i} " * (20 + i % 60)).encode()


def test_damage_is_located(spark):
    whole = [(f"f{i % 3}", i, body(i)) for i in range(600)]
    a = files(spark, whole)
    assert set(states(a, a).values()) == {"ok"} and len(states(a, a)) == 600
    hurt = [(f, i, b"X" + x[1:] if i in (7, 400) else x) for f, i, x in whole]
    got = states(a, files(spark, hurt))
    assert {k[1] for k, s in got.items() if s == "corrupt"} == {7, 400} and sum(s != "ok" for s in got.values()) == 2
    rows = warc.audit(a, files(spark, hurt)).collect()
    opened = [r for r in rows if r["level"] == -1]
    # Only the leaves of the two records were looked at one by one, and f2 was settled by its root.
    assert len(opened) < 150 and {r["level"] for r in rows if r["file"] == "f2"} == {max(r["level"] for r in rows)}
    # f0 and f2 agree; f1 holds both damaged records.
    assert {r["file"] for r in opened} == {f"f{7 % 3}", f"f{400 % 3}"}


def test_lost_added_and_moved_records(spark):
    whole = [("f", i, body(i)) for i in range(200)] + [("g", 1, b"only here")]
    other = [("f", i, body(i)) for i in range(200) if i != 90] + [("f", 999, b"new"), ("h", 5, b"extra file")]
    got = {(k[0], k[1]): s for k, s in states(files(spark, whole), files(spark, other)).items()}
    assert got["f", 90] == "missing" and got["g", 1] == "missing" and got["f", 999] == "extra" and got["h", 5] == "extra"
    assert got["f", 89] == "ok" and {got["f", i] for i in range(91, 200)} == {"moved"}


def test_odd_rows(spark):
    a = files(spark, [(None, None, b"a"), (None, 1, b""), ("f", 2, b"same"), ("f", 2, b"same"), ("f", 3, b"x" * 200_000)])
    assert set(states(a, a).values()) == {"ok"} and warc.audit(a, a).count() == 5
    none = a.limit(0)
    assert {s for s in states(a, none).values()} == {"missing"} and {s for s in states(none, a).values()} == {"extra"}
    assert warc.audit(none, none).count() == 0


def test_records_of_pages(spark):
    rows = [(1, "http://a/", "<p>x"), (2, None, None), (2, None, None), (None, "http://é/", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.records(pages, F.lit("f"), F.col("page_id")).orderBy("offset").collect()
    assert len(made) == 4 and [r["offset"] for r in made] == [sum(x["length"] for x in made[:i]) for i in range(4)]
    for r in made:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        payload = rest[:-4]
        assert rest.endswith(b"\r\n\r\n") and len(r["record"]) == r["length"] and head.startswith(b"WARC/1.1\r\n")
        assert f"Content-Length: {len(payload)}".encode() in head and hashlib.sha256(payload).hexdigest().encode() in head


def test_a_tree_by_hand(spark):
    a = files(spark, [("f", i, bytes([i]) * 9000) for i in range(40)])
    levels, n = warc.tree(warc.hashed(a))
    leaves = {}
    for i in range(40):
        leaves.setdefault(i * 9000 // warc.LEAF_BYTES, []).append(f"{i * 9000:020d}:9000:{hashlib.sha256(bytes([i]) * 9000).hexdigest()}")
    want = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in leaves.items()}
    assert {r["node"]: r["digest"] for r in levels[0].collect()} == want
    up = {}
    for k in sorted(want):
        up.setdefault(k // warc.FANOUT, []).append(f"{k:020d}:{want[k]}")
    want = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
    assert {r["node"]: r["digest"] for r in levels[1].collect()} == want and n == len(levels) == 3


def test_index_is_what_the_written_records_hash_to(spark):
    rows = [(i % 7, f"u{i}", "x" * (i % 50)) for i in range(60)] + [(None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    place = F.lit(1), F.col("page_id")
    written = warc.hashed(warc.records(pages, *place))
    assert sorted(map(str, warc.index(pages, *place).collect())) == sorted(map(str, written.collect()))
    changed = warc.index(pages, *place, kept=lambda record: F.concat(record, F.lit(b"!"))).collect()
    assert sorted((r.offset, r.length - 1) for r in changed) == sorted((r.offset, r.length) for r in written.collect())
