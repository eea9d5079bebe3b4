"""Exact sums over the squares around the centers of one tile, in array steps.

A square is cut along a grid of stripes. Stripes that lie inside it come from running totals over the
grid, one table per item; only points in the stripes its border crosses are read one by one. There are
as many stripes as the root of the number of points, or one per coordinate if these are few. Sums are
exact up to 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# One stripe per coordinate while the grid has at most so many cells a point, and so many in all.
EXACT_CELLS = 10
MOST_CELLS = 4_000_000
# Points, or counts of points, that are looked at together.
BLOCK = 2_000_000
# Buckets along the side of a part of a tile.
PART = 2
# Sums held at once, and values or neighbors handed on together.
TOTALS, VALUES = 8_000_000, 500_000
# Points to a stripe while neighbors are listed, and stripes at most.
RUN_POINTS, MOST_STRIPES = 64, 64
MODES = ["autocrine", "paracrine", "juxtacrine"]


class _Axis:
    """Stripes of one axis, and where the ranges around the centers lie in them."""

    def __init__(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, distinct: np.ndarray, n: int):
        n = min(n, len(distinct))
        cut = np.linspace(0, len(distinct), n + 1).astype(np.int64)
        lows, highs = distinct[cut[:-1]], distinct[cut[1:] - 1]
        self.n, self.size = n, len(distinct)
        self.rank = np.searchsorted(distinct, v)
        self.stripe = np.searchsorted(lows, v, "right") - 1
        # Ranks in range, whole stripes in range, and the ranks of those.
        self.r0, self.r1 = np.searchsorted(distinct, lo, "left"), np.searchsorted(distinct, hi, "right")
        self.s0, end = np.searchsorted(lows, lo, "left"), np.searchsorted(highs, hi, "right")
        self.s1 = np.maximum(self.s0, end)
        self.w0, self.w1 = cut[self.s0], cut[self.s1]
        # Stripes that are partly in range, -1 for none.
        self.first = np.where((self.s0 > 0) & (highs[self.s0 - 1] >= lo), self.s0 - 1, -1)
        self.last = np.where((end < n) & (lows[np.minimum(end, n - 1)] <= hi) & (end != self.first), end, -1)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _read(out, along, across, v, lo, hi, whole, first, code, n):
    """Add the points of partly covered stripes of ``along`` whose other coordinate is in range."""
    width = across.size + 1
    key = along.stripe * width + across.rank
    order = np.argsort(key, kind="stable")
    key = key[order]
    r0, r1 = (across.w0, across.w1) if whole else (across.r0, across.r1)
    for stripe in (along.first, along.last):
        some = np.flatnonzero((stripe >= 0) & (r1 > r0))
        begin = np.searchsorted(key, stripe[some] * width + r0[some])
        size = np.searchsorted(key, stripe[some] * width + r1[some]) - begin
        block = (np.cumsum(size) - size) // BLOCK
        for b in np.unique(block):
            own = block == b
            center = np.repeat(some[own], size[own])
            point = order[_runs(begin[own], size[own])]
            fits = (v[point] >= lo[center]) & (v[point] <= hi[center])
            center, point = center[fits], point[fits]
            for at in range(0, len(point), BLOCK):
                p, c = point[at:at + BLOCK], center[at:at + BLOCK]
                held = first[p + 1] - first[p]
                entry = _runs(first[p], held)
                if len(entry) == 0:
                    continue
                base = c[0]
                flat = np.bincount((np.repeat(c, held) - base) * out.shape[1] + code[entry], n[entry])
                full = np.zeros((c[-1] - base + 1) * out.shape[1])
                full[:len(flat)] = flat
                out[base:c[-1] + 1] += full.reshape(-1, out.shape[1])


def sums(px, py, first, code, n, n_items: int, cx, cy, half: float) -> np.ndarray:
    """Sum of ``n`` per center and item. Point i has the entries ``first[i]`` to ``first[i + 1]`` of code and n."""
    out = np.zeros((len(cx), n_items))
    if len(px) == 0 or len(cx) == 0:
        return out
    lo_x, hi_x, lo_y, hi_y = cx - half, cx + half, cy - half, cy + half
    ux, uy = np.unique(px), np.unique(py)
    exact = len(ux) * len(uy) <= min(EXACT_CELLS * len(px), MOST_CELLS)
    side = math.ceil(math.sqrt(len(px)))
    x = _Axis(px, lo_x, hi_x, ux, len(ux) if exact else side)
    y = _Axis(py, lo_y, hi_y, uy, len(uy) if exact else side)
    cell = np.repeat(x.stripe * y.n + y.stripe, np.diff(first))
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(n_items + 1))
    total = np.zeros((x.n + 1, y.n + 1))
    for i in range(n_items):
        own = order[ends[i]:ends[i + 1]]
        grid = np.bincount(cell[own], n[own], x.n * y.n).reshape(x.n, y.n)
        np.cumsum(np.cumsum(grid, 0), 1, out=total[1:, 1:])
        out[:, i] = total[x.s1, y.s1] - total[x.s0, y.s1] - total[x.s1, y.s0] + total[x.s0, y.s0]
    if not exact:
        _read(out, x, y, px, lo_x, hi_x, False, first, code, n)
        _read(out, y, x, py, lo_y, hi_y, True, first, code, n)
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _codes(fields: list[pa.Array], size: int) -> tuple[np.ndarray, list[list]]:
    """A number for each different combination of fields, and the fields of each number."""
    code, tables = np.zeros(size, np.int64), []
    for f in fields:
        d = f.dictionary_encode(null_encoding="encode")
        code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        tables.append(d.dictionary.to_pylist())
    known, code = np.unique(code, return_inverse=True)
    values: list[list] = []
    for t in reversed(tables):
        values.insert(0, [t[i] for i in known % len(t)])
        known = known // len(t)
    return code, values


def to_lists(centers: np.ndarray, n_centers: int, fields: list[pa.Array], names: list[str]) -> pa.Array:
    """One list of structs per center, from rows sorted by center."""
    offsets = np.searchsorted(centers, np.arange(n_centers + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names))


def item_lists(item: list[str]):
    """Finish a tile with the sums themselves: a list of (item, n) per center."""

    def finish(values: list[list], types: list[pa.DataType], r: np.ndarray) -> pa.Array:
        center, k = np.nonzero(r)
        fields = [pa.array(v, t).take(pa.array(k)) for v, t in zip(values, types)]
        return to_lists(center, len(r), [*fields, pa.array(r[center, k].astype(np.int64))], [*item, "n"])

    return finish


def cell_values(sides: list[tuple], contact: dict[int, bool], n_types: int, half: float, numbers: dict[tuple, int] | None = None):
    """Part (see ``parts_function``) that forms the values of the LR pairs around every cell, as ``interactions.pair_values``
    defines them: lists of (lr_id, kind, value), kind = (celltype1 * n_types + celltype2) * len(MODES) + mode, or of
    (lri_idx, value) with ``numbers`` of the wanted keys.

    ``sides``: (item, lr_id, side). Cells at one position share their sums. Sums are worked out for TOTALS at a time and
    values for VALUES at a time, however dense the cells are; only values other than zero are kept.
    """
    needed: dict[tuple, list[int]] = {}
    for item, lr, side in sides:
        needed.setdefault((lr, side), []).append(item)
    whole = [(lr, is_contact) for lr, is_contact in contact.items() if (lr, "L") in needed and (lr, "R") in needed]

    def lists(pairs: list[tuple], kinds: list[int], at: slice) -> pa.Array:
        rows, keys, amounts, known = [], [], [], []

        def keep(lr: int, t1: int, t2: int, mode: str, amount: np.ndarray) -> None:
            key = (lr, kinds[t1], kinds[t2], mode)
            some = np.flatnonzero(amount) if numbers is None or key in numbers else []
            if len(some):
                rows.append(some)
                keys.append(np.full(len(some), len(known), np.int32))
                amounts.append(amount[some].astype(np.int64))
                known.append(key)

        for lr, is_contact, *sums_of in pairs:
            senders, receivers, both = (v[at] for v in sums_of)
            for a in range(len(kinds)):
                for b in range(len(kinds)):
                    between = senders[:, a] * receivers[:, b] - (both[:, a] if a == b else 0)
                    if not is_contact and a == b:
                        keep(lr, a, b, "autocrine", both[:, a])
                    keep(lr, a, b, "juxtacrine" if is_contact else "paracrine", between)
        size = at.stop - at.start
        row, key, amount = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((rows, np.int64), (keys, np.int32), (amounts, np.int64)))
        order = np.argsort(row.astype(np.uint16) if size < 1 << 16 else row, kind="stable")
        key, amount = key[order], pa.array(amount[order])
        take = lambda v: pa.array(np.array(v, np.int32)[key] if len(v) else key)
        if numbers is not None:
            return to_lists(row[order], size, [take([numbers[k] for k in known]), amount], ["lri_idx", "value"])
        kind = take([(t1 * n_types + t2) * len(MODES) + MODES.index(mode) for _, t1, t2, mode in known])
        return to_lists(row[order], size, [take([k[0] for k in known]), kind, amount], ["lr_id", "kind", "value"])

    def part(table: pa.Table, x: np.ndarray, y: np.ndarray, own: np.ndarray, near: np.ndarray) -> Iterator[tuple]:
        # Cells without items are centers only.
        held = _one(table["items"])
        size = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
        near = near[size[near] > 0]
        first = np.append(0, np.cumsum(size[near])).astype(np.int64)
        kind = np.repeat(table["kind"].to_numpy()[near].astype(np.int64), size[near])
        code, values = _codes([pa.array(kind), held.take(pa.array(near)).flatten()], len(kind))
        kinds, column = sorted(set(values[0])), {key: i for i, key in enumerate(zip(*values))}
        n, n_codes = np.ones(len(code)), len(column)
        own = own[np.lexsort((y[own], x[own]))]
        new = np.append(True, (x[own][1:] != x[own][:-1]) | (y[own][1:] != y[own][:-1]))
        start, position = np.flatnonzero(new), np.cumsum(new) - 1
        block = max(1, TOTALS // max(1, n_codes + 3 * len(whole) * len(kinds)))
        for lo in range(0, len(start), block):
            hi = min(lo + block, len(start))
            r = sums(x[near], y[near], first, code, n, n_codes, x[own[start[lo:hi]]], y[own[start[lo:hi]]], half)

            def least(lr: int, side: str) -> np.ndarray:
                out = np.zeros((len(r), len(kinds)))
                for t, k in enumerate(kinds):
                    found = [column.get((k, item)) for item in needed[lr, side]]
                    if None not in found:
                        out[:, t] = r[:, found].min(1)
                return out

            pairs = [(lr, is_contact, least(lr, "L"), least(lr, "R"), least(lr, "A")) for lr, is_contact in whole]
            # As many values as a center can have at most.
            most = np.zeros(hi - lo, np.int64)
            for _, _, senders, receivers, both in pairs:
                most += np.count_nonzero(senders, 1) * np.count_nonzero(receivers, 1) + np.count_nonzero(both, 1)
            a, end = start[lo], start[hi] if hi < len(start) else len(own)
            ends = np.cumsum(most[position[a:end] - lo])
            while a < end:
                done = ends[a - start[lo] - 1] if a > start[lo] else 0
                b = max(a + 1, start[lo] + int(np.searchsorted(ends, done + VALUES, "right")))
                at = slice(int(position[a]) - lo, int(position[b - 1]) - lo + 1)
                found = lists(pairs, kinds, at)
                if at.stop - at.start < b - a:
                    found = found.take(pa.array(position[a:b] - lo - at.start))
                yield own[a:b], found
                a = b

    return part


def cell_neighbors(half: float):
    """Part (see ``parts_function``) that lists the neighbors of every cell, itself included, in several lists.

    Points are sorted by stripes along x and by y within them: in a stripe that lies inside the square, a center's
    neighbors are one run; in those the border crosses, x is compared too. A list is handed on with about VALUES others.
    """

    def part(table: pa.Table, x: np.ndarray, y: np.ndarray, own: np.ndarray, near: np.ndarray) -> Iterator[tuple]:
        px, py, lo, hi = x[near], y[near], x[own] - half, x[own] + half
        along = _Axis(px, lo, hi, np.unique(px), int(np.clip(len(px) // RUN_POINTS, 1, MOST_STRIPES)))
        across = _Axis(py, y[own] - half, y[own] + half, np.unique(py), 1)
        width = across.size + 1
        key = along.stripe * width + across.rank
        order = np.argsort(key, kind="stable")
        key, px, ids = key[order], px[order], table["cell_id"].to_numpy()[near[order]]

        def cut(center: np.ndarray, stripe: np.ndarray, whole: bool) -> Iterator[tuple]:
            begin = np.searchsorted(key, stripe * width + across.r0[center])
            size = np.searchsorted(key, stripe * width + across.r1[center]) - begin
            ends = np.cumsum(size)
            a = 0
            while a < len(center):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + VALUES, "right")))
                point, c = _runs(begin[a:b], size[a:b]), np.repeat(center[a:b], size[a:b])
                if not whole:
                    fits = (px[point] >= lo[c]) & (px[point] <= hi[c])
                    point, c = point[fits], c[fits]
                if len(c):
                    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    yield own[c[first]], pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(ids[point]))
                a = b

        count = along.s1 - along.s0
        yield from cut(np.repeat(np.arange(len(own)), count), _runs(along.s0, count), True)
        for stripe in (along.first, along.last):
            some = np.flatnonzero(stripe >= 0)
            yield from cut(some, stripe[some], False)

    return part


def parts_function(half: float, wide: int, part, columns: dict[str, str]):
    """Function for ``applyInArrow`` over the cells of a tile of ``wide`` buckets a side and all within their reach.

    The tile is cut into parts of PART x PART buckets. ``part(table, x, y, own, near)``, with the rows of the cells in
    the part and of those within their reach, gives pairs (rows, found): each becomes a batch of the ``columns`` (new
    name and own name) of these rows and ``found``. So a task holds a tile's cells and the results of some of them.
    """
    width = half * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        bx, by = (np.floor(v / width).astype(np.int64) for v in (x, y))
        tx, ty = table["tx"][0].as_py(), table["ty"][0].as_py()
        home = (bx // wide == tx) & (by // wide == ty)
        for sx in range(tx * wide, (tx + 1) * wide, PART):
            for sy in range(ty * wide, (ty + 1) * wide, PART):
                # The last part of a tile may be narrower.
                own = np.flatnonzero(home & (bx >= sx) & (bx < sx + PART) & (by >= sy) & (by < sy + PART))
                if len(own) == 0:
                    continue
                near = np.flatnonzero((bx >= sx - 1) & (bx <= sx + PART) & (by >= sy - 1) & (by <= sy + PART))
                for rows, found in part(table, x, y, own, near):
                    kept = [table[c].take(pa.array(rows)).combine_chunks() for c in columns.values()]
                    yield pa.RecordBatch.from_arrays([*kept, found], [*columns, "found"])

    return run


def tile_function(half: float, item: list[str], center_columns: list[str], finish):
    """Function for ``applyInArrow``: rows without ``items`` are centers, the others points."""

    def run(table: pa.Table) -> pa.Table:
        is_center = pc.is_null(table["items"])
        centers, points = table.filter(is_center), table.filter(pc.invert(is_center))
        lists = _one(points["items"])
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        entries = lists.flatten()
        fields = [entries.field(entries.type.get_field_index(c)) for c in item]
        code, values = _codes(fields, len(entries))
        at = lambda t, c: _one(t[c]).to_numpy(zero_copy_only=False)
        n = entries.field(entries.type.get_field_index("n")).to_numpy(zero_copy_only=False).astype(float)
        r = sums(at(points, "cx"), at(points, "cy"), first, code, n, len(values[0]) if item else 1, at(centers, "cx"), at(centers, "cy"), half)
        found = finish(values, [f.type for f in fields], r)
        return pa.table([*[_one(centers[c]) for c in center_columns], found], names=[*center_columns, "found"])

    return run
