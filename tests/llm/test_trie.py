import hashlib
import random

from cellweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """Nodes of {conversation: [(role, text)]} by following every conversation from the root."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        parts = [below(x) for x in children.get(node, [])]
        return (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))

    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((
            min(found), len(node), parent, len(found), len(children.get(node, [])), *below(node), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def ran(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def rows_of(conversations):
    return [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


def test_random_conversations(spark):
    draw = random.Random(5)
    talks = {c: [("u", draw.choice(["a", "bé", "ccc"])) for _ in range(draw.randint(1, 7))] for c in range(-20, 180)}
    assert ran(trie.prefix_trie(spark.createDataFrame(rows_of(talks), SCHEMA))) == brute(talks)


def test_long_shared_paths_copies_and_prefixes(spark):
    long = [("u", f"turn {i} 😀") for i in range(300)]
    talks = {
        1: long, 2: long, 3: long[:150], 4: long[:150] + [("u", "other")], 5: [*long[:299], ("u", "end")], 6: [("a", "x")] * 120,
        7: [("a", "x")] * 90, 10**15: long[:1], 9: long[:1], -4: [("b", "alone")],
    }
    assert ran(trie.prefix_trie(spark.createDataFrame(rows_of(talks), SCHEMA))) == brute(talks)


def test_one_conversation_and_a_common_one(spark):
    assert ran(trie.prefix_trie(spark.createDataFrame([(5, 0, "u", "hi")], SCHEMA))) == brute({5: [("u", "hi")]})
    talks = {c: [("u", "hi"), ("a", "ho")] for c in range(0, 30_000, 3)}
    assert ran(trie.prefix_trie(spark.createDataFrame(rows_of(talks), SCHEMA))) == brute(talks)


def test_nulls_empty_table_and_other_columns(spark):
    rows = [(1, None, None, None), (1, 3, "a", "x"), (1, -2, "u", None), (2, 0, "", ""), (None, 0, "u", "x"), (3, 1, "u", "same"), (3, 1, "u", "same")]
    found = ran(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS n", "2 AS conv", "3 AS up")))
    assert found == brute({1: [("", ""), ("u", ""), ("a", "x")], 2: [("", "")], 3: [("u", "same")] * 2})
    assert ran(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_turns_of_one_number_have_one_order(spark):
    rows = [(1, 1, "u", "a"), (1, 1, "u", "b"), (1, 1, "a", "c"), (2, 1, "a", "c"), (2, 1, "u", "b"), (2, 1, "u", "a")]
    found = ran(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert [(r[0], r[1], r[3]) for r in found] == [(1, d, 2) for d in range(4)]


def test_rebuilt_conversations_may_be_without_turns(spark):
    from zlib import crc32

    draw = random.Random(3)
    own = {c: [("u", draw.choice("ab")) for _ in range(draw.randint(1, 6))] for c in [*range(0, 60), *range(501, 560), *range(-130, -90)]}
    rebuilt = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(int(c - (abs(c) % 100) * (1 if c >= 0 else -1)), [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    walked = trie.with_heads(trie.walks(spark.createDataFrame(rows_of(own), SCHEMA)), 100, 6)
    assert ran(trie.trie(walked)) == brute(rebuilt)
