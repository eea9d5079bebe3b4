"""Byte-level BPE by replaying merges over a corpus of words.

Each Arrow batch is a corpus: its texts are split into pieces, the distinct pieces that the task has
not met yet are laid side by side, and an inverted index from merge rank to positions replays all
merges in rank order, touching only the neighbours of what was merged. No piece is shuffled.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import give_back, in_turns, small_batches

NO_RANK = np.iinfo(np.int32).max
#: Pieces with their ids that a task keeps; the store is emptied beyond that, which changes no result.
KEPT_PIECES = 120_000
#: Texts are split in turns of so many characters, so that few pieces are held at once.
TURN_CHARS = 1_000_000


class Vocabulary:
    """Ranks of byte strings, every pair of ranked strings whose joint string is ranked, and ids."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.strings = [b""] * self.size
        for text, rank in ranks.items():
            self.strings[rank] = text
        pairs = np.fromiter((
            (ranks[text[:i]] * self.size + ranks[text[i:]], rank)
            for text, rank in ranks.items() for i in range(1, len(text)) if text[:i] in ranks and text[i:] in ranks
        ), [("pair", np.int64), ("rank", np.int32)])
        order = np.argsort(pairs["pair"], kind="stable")
        self.pairs, self.pair_rank = pairs["pair"][order], pairs["rank"][order]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.length = np.array([len(x) for x in self.strings], np.int64)
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.pair_rank[at], NO_RANK) if len(self.pairs) else np.full(len(keys), NO_RANK)


@functools.lru_cache(maxsize=4)
def vocabulary(rank_file: str, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def replay(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each piece, as little-endian unsigned 32-bit numbers.

    In every piece the pair of least rank merges first, the leftmost of equal ones. The index
    holds the positions of each rank over all pieces; the least rank that has any is taken next.
    A merge may make a pair of lower rank than its own: that rank then comes next, and only a
    piece that held further pairs of the interrupted rank could be led astray, so such a piece
    merges one pair at a time.
    """
    direct = [v.ranks.get(p) for p in pieces]
    out = [b"" if d is None else d.to_bytes(4, "little") for d in direct]
    todo = [i for i, d in enumerate(direct) if d is None and pieces[i]]
    if not todo:
        return out
    sizes = np.array([len(pieces[i]) for i in todo])
    flat = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
    n = len(flat)
    piece = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
    token = np.append(v.byte[flat], np.int32(-1))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive, merged = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    rank = np.full(n + 1, NO_RANK, np.int32)
    inner = np.flatnonzero(piece[:-1] == piece[1:])
    rank[inner] = v.rank_of(token[inner], token[inner + 1])
    ends = np.append(piece, np.int32(-1))  # of the position behind the last, no piece
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[rank[at] != NO_RANK]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        starts = [0, *cuts.tolist(), len(at)]
        for a, b, r in zip(starts, starts[1:], rank[at[starts[:-1]]].tolist()):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(at[a:b])

    enter(inner)
    strays: set[int] = set()
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
        if len(found) > 1:
            at = at[np.append(True, at[1:] != at[:-1])]
        at = at[alive[at] & (rank[at] == r)]
        if len(at) > 1:
            # Of pairs that overlap in a row (a a a) every second one, from the left.
            linked = np.zeros(len(at), bool)
            linked[1:] = after[at[:-1]] == at[1:]
            if linked.any():
                starts = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        token[at], alive[gone], rank[gone] = r, False, NO_RANK
        after[at] = after[gone]
        before[after[at]] = at
        left = before[at]
        merged[at] = True
        left = left[(left >= 0) & ~merged[left]]  # each merged position looks to its own right
        merged[at] = False
        left = left[ends[left] == ends[after[left]]]
        touched = np.concatenate([at, left])
        right = after[touched]
        same = ends[touched] == ends[right]
        rank[touched] = NO_RANK
        rank[touched[same]] = v.rank_of(token[touched[same]], token[right[same]])
        low = touched[rank[touched] < r]
        if len(low):
            strays.update(np.intersect1d(piece[low], piece[at][np.append(False, np.diff(piece[at]) == 0)]).tolist())
        enter(touched)
    kept = np.flatnonzero(alive[:n])
    bounds = np.searchsorted(piece[kept], np.arange(len(todo) + 1)).tolist()
    ids = token[kept].astype("<u4").tobytes()
    for j, i in enumerate(todo):
        out[i] = one_by_one(pieces[i], v) if j in strays else ids[4 * bounds[j]:4 * bounds[j + 1]]
    return out


def one_by_one(piece: bytes, v: Vocabulary) -> bytes:
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        ranks = [v.ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        i = int(np.argmin(ranks))
        if ranks[i] == NO_RANK:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return np.array([v.ranks[p] for p in parts], "<u4").tobytes()


def encode_texts(texts: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of whole texts as packed 32-bit numbers; every match of the pattern on its own."""
    out: list[bytes] = []
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= TURN_CHARS):
            chars += len(texts[hi])
            hi += 1
        split = [v.split.findall(t) for t in texts[lo:hi]]
        seen = set(chain.from_iterable(split))
        new = list(seen.difference(v.known))
        if len(v.known) + len(new) > KEPT_PIECES:
            v.known.clear()
            new = list(seen)
        v.known.update(zip(new, replay([p.encode() for p in new], v)))
        get = v.known.__getitem__
        out += [b"".join(map(get, pieces)) for pieces in split]
        lo = hi
    return out


def decode_ids(ids: bytes, v: Vocabulary) -> bytes:
    """The bytes that packed ids stand for; an id outside the vocabulary stands for none."""
    numbers = np.frombuffer(ids, "<u4")
    numbers = numbers[numbers < v.size]
    return b"".join(map(v.strings.__getitem__, numbers.tolist()))


def encoder(rank_file: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    def part(text: pa.Array) -> pa.Array:
        return pa.array(encode_texts([t or "" for t in text.to_pylist()], vocabulary(rank_file, pattern)), pa.binary())

    def encode(text: pa.Array) -> pa.Array:
        return in_turns(text, part, TURN_CHARS)

    return encode


def decoder(rank_file: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    def decode(ids: pa.Array) -> pa.Array:
        v = vocabulary(rank_file, pattern)
        return pa.array([decode_ids(x or b"", v) for x in ids.to_pylist()], pa.binary())

    return decode


def round_trip(rank_file: str, pattern: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def part(text: pa.Array) -> pa.Array:
        v = vocabulary(rank_file, pattern)
        ids = encode_texts([t or "" for t in text.to_pylist()], v)
        decoded = pa.array([decode_ids(x, v) for x in ids], pa.binary())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for text in texts:
                yield in_turns(text, part, TURN_CHARS)
        finally:
            # The worker lives on and may not encode again.
            vocabulary.cache_clear()
            give_back()

    return both


def encode_and_decode(
    docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
) -> DataFrame:
    """``encode`` and ``decode`` in one pass: the ids need not travel between Python workers, of
    which a task then has one."""
    docs = small_batches(docs)
    coded = docs.withColumn("__coded", arrow_udf(round_trip(rank_file, pattern), "struct<ids:binary,decoded:binary>")(F.col(text)))
    return coded.withColumn(ids, F.col("__coded.ids")).withColumn(decoded, F.col("__coded.decoded")).drop("__coded")


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column of token ids (little-endian unsigned 32-bit) of whole texts.

    Null and empty texts have no ids; repeated rows stay; an empty table stays empty; an input
    column named like ``ids`` is replaced, all others pass through. ``rank_file`` must be readable
    on every executor.
    """
    return docs.withColumn(ids, arrow_udf(encoder(rank_file, pattern), "binary")(F.col(text)))


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with a binary column of the bytes that the ids stand for (null ids: none)."""
    return docs.withColumn(decoded, arrow_udf(decoder(rank_file, pattern), "binary")(F.col(ids)))
