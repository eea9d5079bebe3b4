import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cellweave.llm import bpe

WHERE = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(WHERE[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(ids):
    return np.frombuffer(bytes(ids), "<u4").tolist()


def test_random_texts(exact):
    random.seed(5)
    texts = ["".join(random.choice("ab cdeéà漢字😀\n\t 12ÀÖthe in aa") for _ in range(random.randrange(200))) for _ in range(400)]
    texts += ["a" * n for n in range(60)] + ["", "\x00\x1c\x85", "<|endoftext|>", "ᄀᄁ" * 9, " " * 50 + "x"]
    v = bpe.vocabulary(*WHERE)
    got = bpe.encode_texts(texts, v)
    assert [numbers(g) for g in got] == [exact.encode_ordinary(t) for t in texts]
    assert [bpe.decode_ids(g, v) for g in got] == [t.encode() for t in texts]


def test_results_do_not_depend_on_what_is_kept(exact, monkeypatch):
    texts = [f"word{i} other{i % 7}s running" for i in range(200)]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(bpe, "TURN_CHARS", 40)
    assert [numbers(g) for g in bpe.encode_texts(texts, bpe.vocabulary(*WHERE))] == [exact.encode_ordinary(t) for t in texts]


def test_low_rank_after_a_merge():
    # "bc" (rank 3) makes "a" + "bc" = "abc" of rank 2, which must come before the second "bc".
    class Own(bpe.Vocabulary):
        def __init__(self):
            ranks = {b"abc": 2, b"bc": 3, b"cbc": 4} | {bytes([i]): 10 + i for i in range(256)}
            self.ranks, self.size = ranks, 266
            pairs = {ranks[t[:i]] * 266 + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
            self.pairs = np.array(sorted(pairs), np.int64)
            self.pair_rank = np.array([pairs[x] for x in self.pairs.tolist()], np.int32)
            self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    v = Own()
    for piece in (b"abcbc", b"bcbcbc", b"abcabcbcc", b"cbcabc"):
        assert bpe.replay([piece], v) == [v.ranks[piece].to_bytes(4, "little") if piece in v.ranks else bpe.one_by_one(piece, v)]


def test_rows(odd_docs, no_docs, exact):
    coded = bpe.decode(bpe.encode(odd_docs.withColumnRenamed("keep", "ids"), *WHERE), *WHERE)
    rows = coded.collect()
    assert len(rows) == odd_docs.count() and set(coded.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "key", "decoded"}
    for r in rows:
        assert numbers(r["ids"]) == exact.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    both = bpe.encode_and_decode(odd_docs.withColumnRenamed("keep", "ids"), *WHERE)
    assert sorted(map(str, both.select(coded.columns).collect())) == sorted(map(str, rows))
    assert bpe.encode(no_docs, *WHERE).count() == 0 and bpe.encode_and_decode(no_docs, *WHERE).count() == 0
