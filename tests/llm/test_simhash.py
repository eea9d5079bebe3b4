import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import simhash
from cellweave.llm.components import components

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, most=4):
    """Root of each value by comparing all pairs."""
    values, root = sorted(values), {}
    for v in values:
        root[v] = v

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= most and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def same_classes(got, want):
    pairs = {(got[v], want[v]) for v in want}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_segments_leave_one_bit():
    for d in range(1, 9):
        cuts = simhash.segments(d)
        assert sum(n for _, n in cuts) == 64 and d // len(cuts) <= 1


def test_documents_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in rows} == want
    root = groups(set(want.values()))
    least = {}
    for i, v in want.items():
        least[root[v]] = min(i, least.get(root[v], i))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: least[root[v]] for i, v in want.items()}


def test_links_in_hot_buckets(spark, monkeypatch):
    """Chains of near values far larger than a block still give the components of all pairs."""
    random.seed(2)
    values = set()
    for _ in range(4):
        v = random.getrandbits(64)
        for _ in range(150):
            values.add(v)
            for _ in range(random.randrange(1, 6)):
                v ^= 1 << random.randrange(12)
        values.add(v ^ 0b11110000 << 40)
    values |= {random.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = groups(values)
    for block in (2048, 40):
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = simhash.links(df)
        rows = components(edges).collect()
        root = {v: v for v in values} | {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in rows}
        assert same_classes(root, want)
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in edges.collect())


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (6001, 6000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {6000: 6000, 6001: 6000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == {(by[1].copy().pop()[0], 1)} and {x[0] for x in by[3]} == {x[0] for x in by[4]} == {x[0] for x in by[6]} == {0}
    assert by[4] == {(0, 3)} and {x[1] for x in by[None]} == {1, 3}
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert simhash.deduplicated(lone).count() == 1
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "q r s t u"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.deduplicated(twice).collect()) == ["a b c d e", "q r s t u"]
    shared = spark.createDataFrame([(1, "a b c d e"), (5, "a b c d e"), (5, "q r s t u"), (9, "q r s t u")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.deduplicated(shared).collect()) == [(1, "a b c d e"), (5, "q r s t u")]


def test_long_texts_in_one_batch(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("lorem ipsum dolor sit amet "), 60_000).alias("text"))
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0}
