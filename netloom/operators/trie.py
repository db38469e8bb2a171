"""Prefixes of sorted addresses, in numpy: what a task of structure does with the rows that Spark has brought to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DENSE, Q_STEP, Q_FIRST, Q_LAST = 0.95, 8, -4, 28
#: Bits of an address below its block; a set has 65,536 blocks at most.
HALF = 16
#: Rows that are worked on at once, if no group has more.
ROWS = 1 << 16
COUNTS = "len int, prefix long, n long, m long, c long"
PREFIXES = "len int, prefix long, n long"
MEASURES = "lo int, hi int, total long, splits boolean, points array<struct<q8:int,tau:double,sd:double>>, spectrum array<struct<q8:int,alpha:double,f:double>>, dim double"


def _first(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in one of the columns."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for name in names:
        c = table[name].combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if c.null_count:
            differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, rows that agree in the columns; these follow each other."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, ROWS
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_first(table, names))[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size -= cut
            enough = max(ROWS, 2 * size)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns changes."""
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _parents(group: np.ndarray, v: np.ndarray, n: np.ndarray, length: int, levels: int):
    """(length, first row, prefix, n, addresses of the larger half) of the lengths before that of the prefixes v, which are sorted by group."""
    rows = np.arange(len(v))
    for up in range(1, levels + 1):
        first = _starts(group, v >> 1)
        one = np.add.reduceat(n * (v & 1), first)
        n = np.add.reduceat(n, first)
        group, v, rows = group[first], v[first] >> 1, rows[first]
        yield length - up, rows, v, n, np.maximum(one, n - one)


def _keyed(table: pa.Table, keys: list[str], rows: np.ndarray, **columns) -> pa.RecordBatch:
    keyed = table.select(keys).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*(keyed[k].combine_chunks() for k in keys), *map(pa.array, columns.values())], names=[*keys, *columns])


def _stacked(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def long_prefixes(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the lengths 16 to 32 from (keys, a, block), sorted, blocks whole."""
    for t in _whole(batches, [*keys, "block"]):
        a, group = _numbers(t, "a"), np.cumsum(_first(t, [*keys, "block"]))
        n = np.ones(len(a), dtype=np.int64)
        yield _keyed(t, keys, np.arange(len(a)), len=np.full(len(a), 32, dtype=np.int32), prefix=a, n=n)
        for length, rows, v, n, _ in _parents(group, a, n, 32, HALF):
            yield _keyed(t, keys, rows, len=np.full(len(v), length, dtype=np.int32), prefix=v, n=n)


def short_prefixes(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the lengths 0 to 15 from (keys, block, n), sorted, sets whole."""
    for t in _whole(batches, keys):
        for length, rows, v, n, _ in _parents(np.cumsum(_first(t, keys)), _numbers(t, "block"), _numbers(t, "n"), HALF, HALF):
            yield _keyed(t, keys, rows, len=np.full(len(v), length, dtype=np.int32), prefix=v, n=n)


def block_counts(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (keys, a, block), sorted, blocks whole: a row for each block with its addresses n, and how many prefixes (c) of the lengths 16 to 31
    have n addresses, over one, with m of them in the larger half; these have the prefix -1."""
    for t in _whole(batches, [*keys, "block"]):
        a, group, sets = _numbers(t, "a"), np.cumsum(_first(t, [*keys, "block"])), _first(t, keys)
        begins, sets = np.flatnonzero(sets), np.cumsum(sets) - 1
        parts = []
        for length, rows, v, n, m in _parents(group, a, np.ones(len(a), dtype=np.int64), 32, HALF):
            many = np.flatnonzero(n > 1)
            s, x, y = sets[rows[many]], n[many], m[many]
            order = np.lexsort((y, x, s))
            s, x, y = s[order], x[order], y[order]
            first = _starts(s, x, y) if len(s) else order
            parts.append((begins[s[first]], np.full(len(first), length), np.full(len(first), -1), x[first], y[first], np.diff(np.append(first, len(s)))))
            if length == HALF:
                parts.append((rows, np.full(len(v), length), v, n, np.zeros_like(v), np.ones_like(v)))
        rows, length, prefix, n, m, c = _stacked(parts)
        yield _keyed(t, keys, rows, len=length.astype(np.int32), prefix=prefix, n=n, m=m, c=c)


def measures(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set from block_counts, sorted by keys and prefix, sets whole."""
    for t in _whole(batches, keys):
        first = _first(t, keys)
        begins, sets, prefix = np.flatnonzero(first), np.cumsum(first) - 1, _numbers(t, "prefix")
        block, n = prefix >= 0, _numbers(t, "n")
        s, length, x, m, c = (v[~block] for v in (sets, _numbers(t, "len").astype(np.int64), n, _numbers(t, "m"), _numbers(t, "c")))
        parts = [(s, length, x, m, c)]
        own, total = sets[block], None
        for above, rows, _, total, m in _parents(own, prefix[block], n[block], HALF, HALF):  # the last are those of length 0
            many = np.flatnonzero(total > 1)
            parts.append((own[rows[many]], np.full(len(many), above), total[many], m[many], np.ones(len(many), dtype=np.int64)))
        yield _keyed(t, keys, begins, **_measures(total, *_stacked(parts)))


def _measures(total: np.ndarray, s: np.ndarray, length: np.ndarray, n: np.ndarray, m: np.ndarray, c: np.ndarray) -> dict:
    """Of sets with total addresses; in set s, c prefixes of a length have n addresses, over one, with m of them in the larger half. Other prefixes have one."""
    k = len(total)
    cell = lambda v: np.bincount(s * 33 + length, weights=v, minlength=k * 33).reshape(k, 33)
    alone = total[:, None] - cell(c * n)
    lo = (1 + np.argmax(alone[:, 1:] > 0, axis=1)).astype(np.int32)
    hi = np.full(k, 32, dtype=np.int32)
    full = (length >= 1) & (n / 2.0 ** (32 - length) >= DENSE)
    np.minimum.at(hi, s[full], length[full].astype(np.int32))
    bound = (total >= 2) & (hi >= lo)
    lengths = (hi - lo + 1).astype(float)
    share = n / total[s]
    h = cell(c * share * np.log2(share)) - alone / total[:, None] * np.log2(total[:, None])
    dim = _slope(-np.arange(33.0), h, (np.arange(33) >= lo[:, None]) & (np.arange(33) <= hi[:, None]))

    used = np.flatnonzero(bound[s] & (length >= lo[s]) & (length <= hi[s]))
    used = used[np.lexsort((m[used], n[used], length[used], s[used]))]  # one order of sums, however the rows came
    s, length, n, m, c = (v[used] for v in (s, length, n, m, c))
    tau, sd = np.zeros((2, k, Q_LAST - Q_FIRST + 1))
    if len(used):
        first = _starts(s, length)
        at = s[first]
        values, place = np.unique(np.concatenate((n, m, n - m)), return_inverse=True)
        of_n, of_m, of_rest = np.split(place, 3)
        added = lambda v: np.add.reduceat(c * v, first)
        for j, q8 in enumerate(range(Q_FIRST, Q_LAST + 1)):
            power = np.where(values > 0, np.maximum(values, 1).astype(float) ** (q8 / Q_STEP), 0.0)
            x, y = power[of_n], power[of_m] + power[of_rest]
            z, w = added(x), added(y)
            # Σ(x/Z - y/Z')² = Σx²/Z² - 2Σxy/(Z Z') + Σy²/Z'²
            d2 = added(x * x) / (z * z) - 2 * added(x * y) / (z * w) + added(y * y) / (w * w)
            tau[:, j] = np.bincount(at, weights=np.log2(z) - np.log2(w), minlength=k) / lengths
            sd[:, j] = np.sqrt(np.bincount(at, weights=np.maximum(d2, 0.0), minlength=k) / lengths)
    splits = np.zeros(k, dtype=bool)
    splits[s] = True
    alpha, f, run = _spectrum(tau)
    q8 = np.broadcast_to(np.arange(Q_FIRST, Q_LAST + 1, dtype=np.int32), tau.shape)
    points, run = np.broadcast_to(bound[:, None], tau.shape), run & bound[:, None]
    return {
        "lo": lo, "hi": hi, "total": total, "splits": splits, "points": _lists(points, q8=q8, tau=tau, sd=sd),
        "spectrum": _lists(run, q8=q8[:, 1:-1], alpha=alpha, f=f), "dim": pa.array(dim, mask=~bound),
    }


def _slope(x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Of the regression of each row's y, where on; 0 for a single point."""
    count = np.maximum(on.sum(axis=1), 1)[:, None]
    y = np.where(on, y, 0.0)
    dx = np.where(on, x - (on * x).sum(axis=1)[:, None] / count, 0.0)
    dy = np.where(on, y - y.sum(axis=1)[:, None] / count, 0.0)
    xx = (dx * dx).sum(axis=1)
    return np.where(xx > 0, (dx * dy).sum(axis=1) / np.where(xx > 0, xx, 1.0), 0.0)


def _spectrum(tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, f, whether the point counts) of all q but the first and the last: the first strictly decreasing run of alpha, without its first point."""
    alpha = (tau[:, 2:] - tau[:, :-2]) / (2 / Q_STEP)
    falls = np.zeros(alpha.shape, dtype=bool)
    falls[:, 1:] = alpha[:, :-1] - alpha[:, 1:] > 1e-9  # flat is not decreasing
    stopped = np.logical_or.accumulate(~falls & np.logical_or.accumulate(falls, axis=1), axis=1)
    return alpha, np.arange(Q_FIRST + 1, Q_LAST) / Q_STEP * alpha - tau[:, 1:-1], falls & ~stopped


def _lists(on: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """A list of structs for each row, of the places that are on."""
    ends = np.cumsum(on.sum(axis=1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.StructArray.from_arrays([pa.array(v[on]) for v in fields.values()], names=list(fields)))
