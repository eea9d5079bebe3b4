"""Shared helpers: stored tables, null-safe document keys, vectorized words of Arrow text columns."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import cleaned_shuffles, scratch_path

_U = np.uint64
_LIBC = ctypes.CDLL(None)
_BASE, _BASE_WORD = _U(0x9E3779B97F4A7C15 | 1), _U(0xD1B54A32D192ED03 | 1)


#: Paths of what was stored inside each open ``scratch`` block.
_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside the block are deleted at its end, but for those taken off the list it gives."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written.pop()
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends at durable files, and the
    shuffle files it was made from are deleted."""
    path = scratch_path(df.sparkSession, name)
    if _written:
        _written[-1].append(path)
    with cleaned_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: a batch's texts and all that is made of them are in memory together.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the session's Arrow batches to BATCH_ROWS rows from here on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def document_key(doc_id: str, text: str) -> Column:
    """The document's id; a row without one gets a negative number made from its text, so equal
    texts without an id count as one document."""
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(F.col(doc_id).cast("long"), own.bitwiseOR(F.lit(-(2**63)).cast("long")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each row starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def give_back() -> None:
    """Return memory that freed arrays still hold to the system, and long tables of powers with it: a
    Python worker lives on between tasks."""
    for base in [b for b, kept in _kept.items() if len(kept[0]) > KEPT_POWERS]:
        del _kept[base]
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def in_turns(column: pa.Array, work, most: int = 1 << 19) -> pa.Array:
    """``work`` applied to slices of a text column of about ``most`` bytes, so that its arrays stay
    small whatever the batch; one longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at = utf8(column)
    parts, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        parts.append(work(column.slice(lo, hi - lo)))
        lo = hi
    out = pa.concat_arrays(parts) if parts else work(column)
    del parts
    give_back()
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the two word definitions: anything but ASCII white space; letters, digits and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False


class Words:
    """The words of every row of a text column, found in whole-batch array steps.

    ``start``/``end`` are byte positions in ``data`` (lower-cased), ``first[r]:first[r + 1]`` are
    the words of row r, ``hash`` is a 64-bit polynomial hash of each word.
    """

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = SPACED):
        raw, at = utf8(column)
        self.raw, self.at, self.data = raw, at, LOWER[raw]
        inside = word_bytes[self.data]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside
        before[at] = False  # a row's first byte has nothing before it, its last nothing behind it
        starts = inside & ~before[:-1]
        behind = np.zeros(len(raw) + 1, bool)
        behind[:-1] = inside
        behind[at] = False
        ends = inside & ~behind[1:]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    @cached_property
    def _sums(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * _powers(len(self.data), _BASE)[0], out=sums[1:])
        return sums

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (of all, if there are fewer)."""
        return self._hash(np.minimum(self.start + size, self.end))

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hash(self.end)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[self.start]) * _powers(len(self.data) + 1, _BASE)[1][self.start])

    def grams(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Hash of each run of k words; runs that leave their row hold the greatest value."""
        n = len(hashes)
        out = np.full(n, np.iinfo(np.uint64).max, _U)
        if n >= k:
            powers, inverse = _powers(n + 1, _BASE_WORD)
            sums = np.zeros(n + 1, _U)
            np.cumsum(hashes * powers[:-1], out=sums[1:])
            out[:n - k + 1] = mix((sums[k:] - sums[:n - k + 1]) * inverse[:n - k + 1])
        left = self.first[1:][self.row] - np.arange(n)
        out[left < k] = np.iinfo(np.uint64).max
        return out


_kept: dict = {}
#: Powers kept from one batch to the next.
KEPT_POWERS = 1 << 16


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _kept or len(_kept[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        back = _U(pow(int(base), -1, 2**64))
        _kept[base] = tuple(
            np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(size - 1, b, _U))]) for b in (base, back)
        )
    return tuple(x[:n] for x in _kept[base])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    return x * _U(0xD6E8FEB86659FD93) ^ (x >> _U(29))
