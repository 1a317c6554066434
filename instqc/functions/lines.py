"""Vectorised work on lines of voxels, for Arrow columns that hold one line per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a matrix of lines that are worked on at once.
CELLS = 1 << 20


def ragged(column: pa.Array, kind: type, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column one after another, nulls replaced, and the length of each list."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype.kind == "f" and np.isnan(flat).any():
        flat = np.where(np.isnan(flat), missing, flat)
    return flat.astype(kind), lengths


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, lengths.cumsum()], pa.int32()), values)


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """min over p of heights[i, p] + (q - p)**2 for every line i and place q.

    Every finite height stands for a parabola. Going along the lines, all at
    once, each line keeps the stack of parabolas that are lowest somewhere so
    far and the place from which each of them is; a new one takes off those
    that it undercuts from their start on. Each is put on and taken off once,
    so the work is linear in the number of cells. Places that no parabola
    reaches are infinite.
    """
    m, n = heights.shape
    squares = np.arange(n, dtype=float) ** 2
    owner, start = np.zeros((m, n), np.int32), np.zeros((m, n))
    top = np.full(m, -1)
    for q in range(n):
        lines = np.flatnonzero(np.isfinite(heights[:, q]))
        begin = np.zeros(m)
        open_ = lines[top[lines] >= 0]
        while len(open_):
            p = owner[open_, top[open_]]
            meet = (heights[open_, q] + squares[q] - heights[open_, p] - squares[p]) / (2.0 * (q - p))
            first = np.floor(meet) + 1
            undercut = first <= start[open_, top[open_]]
            begin[open_[~undercut]] = first[~undercut]
            open_ = open_[undercut]
            top[open_] -= 1
            begin[open_] = 0.0
            open_ = open_[top[open_] >= 0]
        lines = lines[begin[lines] < n]
        top[lines] += 1
        owner[lines, top[lines]], start[lines, top[lines]] = q, begin[lines]
    out = np.full((m, n), np.inf)
    at = np.zeros(m, np.int64)
    lines = np.flatnonzero(top >= 0)
    for q in range(n):
        onward = lines[at[lines] < top[lines]]
        onward = onward[start[onward, at[onward] + 1] <= q]
        at[onward] += 1
        p = owner[lines, at[lines]]
        out[lines, q] = heights[lines, p] + (q - p) ** 2.0
    return out


def run_distances(places: pa.Array, squared: pa.Array, size: pa.Array) -> pa.Array:
    """Lower the squared distances along lines; see ``edt``.

    A line lists rising places with the squared distance known so far, null if
    none. Its runs of neighbouring places are bounded by background, which is
    at distance 0, unless they end at the grid.
    """
    p, lengths = ragged(places, np.int64, 0)
    d, _ = ragged(squared, float, np.inf)
    line = np.repeat(np.arange(len(lengths)), lengths)
    new = np.r_[True, (line[1:] != line[:-1]) | (p[1:] != p[:-1] + 1)] if len(p) else np.empty(0, bool)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    count = np.diff(np.r_[first, len(p)])
    ends_inside = p[first + count - 1] < np.asarray(size)[line[first]] - 1
    begins_inside = p[first] > 0
    within = np.arange(len(p)) - np.repeat(first, count) + 1
    best = np.empty(len(p))
    order = np.argsort(count, kind="stable")
    done = 0
    while done < len(order):
        # Runs of like length share a matrix of bounded size.
        take = order[done:]
        take = take[: max(1, int(np.searchsorted((np.arange(len(take)) + 1) * (count[take] + 2), CELLS, "right")))]
        done += len(take)
        row = np.full(len(first), -1)
        row[take] = np.arange(len(take))
        cells = np.flatnonzero(row[run] >= 0)
        at = row[run[cells]], within[cells]
        heights = np.full((len(take), int(count[take].max()) + 2), np.inf)
        heights[at] = d[cells]
        heights[begins_inside[take], 0] = 0.0
        closed = np.flatnonzero(ends_inside[take])
        heights[closed, count[take[closed]] + 1] = 0.0
        best[cells] = lower_envelope(heights)[at]
    known = np.isfinite(best)
    return lists(pa.array(np.where(known, best, 0).astype(np.int64), pa.int64(), mask=~known), lengths)


def smoothed(places: pa.Array, values: pa.Array, size: pa.Array, kernel: np.ndarray) -> pa.Array:
    """Convolution of lines with a symmetric kernel; the border is mirrored at the voxel edge.

    A line lists places and values, 0 elsewhere. The result lists every place
    (p) that the kernel carries a listed one to, with its sum (v).
    """
    p, lengths = ragged(places, np.int64, 0)
    v, _ = ragged(values, float, 0.0)
    sizes = np.asarray(size).astype(np.int64)
    radius = len(kernel) // 2
    line = np.repeat(np.arange(len(lengths)), lengths)
    counts, found_p, found_v = np.zeros(len(lengths), np.int64), [], []
    order = []
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for part in np.array_split(same, max(1, len(same) * (n + 2 * radius) // CELLS)):
            row = np.full(len(lengths), -1)
            row[part] = np.arange(len(part))
            cells = np.flatnonzero((row[line] >= 0) & (p >= 0) & (p < n))
            dense, held = np.zeros((len(part), n)), np.zeros((len(part), n), bool)
            dense[row[line[cells]], p[cells]], held[row[line[cells]], p[cells]] = v[cells], True
            dense, held = (np.pad(x, ((0, 0), (radius, radius)), "symmetric") for x in (dense, held))
            total, reached = np.zeros((len(part), n)), np.zeros((len(part), n), bool)
            for k, weight in enumerate(kernel):
                total += weight * dense[:, k : k + n]
                reached |= held[:, k : k + n]
            rows, where = np.nonzero(reached)
            counts[part] = reached.sum(1)
            found_p.append(where)
            found_v.append(total[rows, where])
            order.append(part[rows])
    if order:
        sort = np.argsort(np.concatenate(order), kind="stable")
        found_p, found_v = np.concatenate(found_p)[sort], np.concatenate(found_v)[sort]
    cells = pa.StructArray.from_arrays([pa.array(found_p, pa.int32()), pa.array(found_v, pa.float64())], names=["p", "v"])
    return lists(cells, counts)


def changes(*columns: pa.ChunkedArray | np.ndarray) -> np.ndarray:
    """For every row but the first whether any column differs from the row before."""
    differs = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differs |= c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return differs


def whole_groups(keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table]):
    """Function over Arrow batches of rows in order of ``keys``: ``work`` gets whole groups and the number of each row's group.

    What a batch leaves open of its last group waits for the next batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, differs: np.ndarray) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from work(table, np.r_[0, np.cumsum(differs[: table.num_rows - 1])]).to_batches()

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting and not any(waiting[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys) and not changes(*[pa.chunked_array([batch[k]]) for k in keys]).any():
                waiting.append(batch)  # all of one group
                continue
            table = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            differs = changes(*[table[k] for k in keys])
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            yield from done(table.slice(0, last), differs)
            waiting = table.slice(last).to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from done(table, changes(*[table[k] for k in keys]))

    return run


def _as_lines(group: np.ndarray, line: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of cells by line and place, the number of cells of each line, and its first cell."""
    order = np.lexsort((place, line, group))
    first = np.flatnonzero(np.r_[True, changes(group[order], line[order])]) if len(order) else np.empty(0, np.int64)
    return order, np.diff(np.r_[first, len(order)]), order[first]


def lowered(group: np.ndarray, line: np.ndarray, place: np.ndarray, squared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``run_distances`` of cells given one by one; infinite where nothing is known."""
    order, lengths, first = _as_lines(group, line, place)
    known = np.isfinite(squared[order])
    held = pa.array(np.where(known, squared[order], 0).astype(np.int64), mask=~known)
    best = run_distances(lists(pa.array(place[order]), lengths), lists(held, lengths), size[first])
    out = np.empty(len(order))
    out[order] = ragged(best, float, np.inf)[0]
    return out


def spread(group: np.ndarray, line: np.ndarray, place: np.ndarray, values: np.ndarray, size: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``smoothed`` of cells given one by one: a cell of the line, the place and the sum of every place reached."""
    order, lengths, first = _as_lines(group, line, place)
    cells = smoothed(lists(pa.array(place[order]), lengths), lists(pa.array(values[order]), lengths), size[first], kernel)
    flat = cells.flatten()
    return np.repeat(first, np.diff(cells.offsets.to_numpy())), flat.field("p").to_numpy().astype(np.int64), flat.field("v").to_numpy()
