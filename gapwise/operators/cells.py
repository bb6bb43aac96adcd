"""Box geometry for exact nearest neighbours when coordinates may be missing.

Squared distance of two rows: p / common * sum of squared differences over the coordinates present in
both. For a box of rows that share one pattern this gives exact lower and upper bounds; for a mixed
box the lower bound uses only the coordinates present in all of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Distances are compared after rounding to this many decimals, then by donor key.
DECIMALS = 9
SLACK = 1e-9
NEAR = 2 * 10.0**-DECIMALS  # distances that round alike are no further apart
LEAF_ROWS = 32         # donors aimed at per leaf of a tree in memory
FIRST_LEAVES = 4       # leaves that a query reads before the others
QUERY_ROWS = 4096      # queries that go down such a tree together
MANY_BOXES = 32        # boxes of a cell's size that a row may touch before finer ones are asked


@dataclass(frozen=True)
class Splits:
    """A complete binary tree of axis cuts; rows are routed by their values with gaps read as 0."""
    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        z = np.nan_to_num(x)
        for _ in range(self.depth):
            at = 2 * at + 1 + (z[rows, self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def cut_sample(x: np.ndarray, depth: int) -> Splits:
    """Median cuts along the widest axis. The sample only shapes the boxes, never the result."""
    z = np.nan_to_num(x)
    size = 2**depth - 1
    axis, cut = np.zeros(size, dtype=np.int64), np.zeros(size)
    groups = {0: z}
    for node in range(size):
        part = groups.pop(node, z[:0])
        if len(part):
            axis[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            values = part[:, axis[node]]
            cut[node] = np.median(values)
            if cut[node] == values.max():  # heavy ties at the top: cut below them
                lower = values[values < cut[node]]
                cut[node] = lower.max() if len(lower) else cut[node]
            right = values > cut[node]
            groups[2 * node + 1], groups[2 * node + 2] = part[~right], part[right]
    return Splits(axis, cut, depth)


@dataclass(frozen=True)
class Boxes:
    """Per box: value range and presence per coordinate, whether all rows share a pattern, row count."""
    low: np.ndarray
    high: np.ndarray
    full: np.ndarray
    exact: np.ndarray
    count: np.ndarray


def box_bounds(low: np.ndarray, high: np.ndarray, present: np.ndarray, boxes: Boxes,
               p: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distance between query boxes (one pattern each) and donor boxes.

    Unreachable pairs get a lower bound of infinity; an upper bound of infinity means "not known".
    """
    common = present[:, None, :] & boxes.full[None, :, :]
    n_common = common.sum(axis=2)
    lo, hi = np.nan_to_num(boxes.low)[None], np.nan_to_num(boxes.high)[None]
    qlo, qhi = np.nan_to_num(low)[:, None], np.nan_to_num(high)[:, None]
    near = np.where(common, np.maximum(0.0, np.maximum(lo - qhi, qlo - hi)), 0.0)
    far = np.where(common, np.maximum(hi - qlo, qhi - lo), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(boxes.exact[None], p / n_common, p / present.sum(axis=1)[:, None])
        lower = np.where(n_common > 0, least * (near**2).sum(axis=2), 0.0)
        upper = np.where(boxes.exact[None] & (n_common > 0), p / n_common * (far**2).sum(axis=2), np.inf)
    lower = np.where(boxes.exact[None] & (n_common == 0), np.inf, lower)
    lower[present.sum(axis=1) == 0] = np.inf
    return lower * (1 - SLACK) - SLACK, upper


def kth_upper(upper: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Smallest bound that at least ``k`` donors are certain to meet; infinity if there are fewer."""
    order = np.argsort(upper, axis=1)
    ranked = np.take_along_axis(upper, order, axis=1)
    reached = np.cumsum(count[order], axis=1) >= k
    first = np.argmax(reached, axis=1)
    bound = ranked[np.arange(len(upper)), first]
    return np.where(reached.any(axis=1), bound, np.inf)


def merged(boxes: Boxes, into: np.ndarray) -> Boxes:
    """The boxes with one number in ``into`` (0, 1, 2 ... all of them used) as one box."""
    order = np.argsort(into, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(into[order]) != 0])
    over = lambda how, a: how.reduceat(a[order], first, axis=0)
    return Boxes(over(np.fmin, boxes.low), over(np.fmax, boxes.high), over(np.logical_and, boxes.full),
                 over(np.logical_and, boxes.exact), over(np.add, boxes.count))


def _subset(boxes: Boxes, keep: np.ndarray) -> Boxes:
    return Boxes(boxes.low[keep], boxes.high[keep], boxes.full[keep], boxes.exact[keep], boxes.count[keep])


def reachable(x: np.ndarray, boxes: Boxes, k: int, p: int,
              groups: list[np.ndarray], limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, box) pairs in which one of the row's k nearest donors may lie, and a bound per row.

    Within the bound lie at least k donors, so nothing beyond it matters. ``groups`` lists labels from
    coarse to fine: rows that share a label (and a pattern) are first tested together by their common
    box, and only the boxes that survive are tested further down, finally row by row. ``limit`` is a bound per row
    that is known already, from donors outside these boxes.
    """
    present = ~np.isnan(x)
    pattern = np.unique(present, axis=0, return_inverse=True)[1].ravel()
    rows_out, boxes_out, bound = [], [], np.full(len(x), np.inf)
    todo = [(np.arange(len(x)), np.arange(len(boxes.count)), 0)]
    while todo:
        rows, keep, level = todo.pop()
        if level < len(groups):
            for part in _split_by(rows, groups[level][rows] * (pattern.max() + 1) + pattern[rows]):
                if level and len(part) < 4:  # too few to share a test
                    todo.append((part, keep, len(groups)))
                    continue
                lower, upper = box_bounds(x[part].min(axis=0)[None], x[part].max(axis=0)[None], present[part[:1]],
                                          _subset(boxes, keep), p)
                near = np.isfinite(lower[0]) & (lower[0] <= kth_upper(upper, boxes.count[keep], k)[0])
                if near.any():
                    todo.append((part, keep[near], level + 1))
            continue
        sub = _subset(boxes, keep)
        step = max(1, 2_000_000 // (len(keep) * x.shape[1]))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            lower, upper = box_bounds(x[part], x[part], present[part], sub, p)
            bound[part] = kth_upper(upper, sub.count, k)
            most = bound[part] if limit is None else np.minimum(bound[part], limit[part])
            hit = np.isfinite(lower) & (lower <= most[:, None])
            r, b = np.nonzero(hit)
            rows_out.append(part[r])
            boxes_out.append(keep[b])
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), bound
    return np.concatenate(rows_out), np.concatenate(boxes_out), bound


def _split_by(rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return np.split(rows[order], cuts)


def _blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row sets of at most ``size`` rows (more only if identical), one pattern each, close in space."""
    out = []
    tag = np.unique(np.isnan(x), axis=0, return_inverse=True)[1].ravel()
    z = np.nan_to_num(x)
    todo = [np.flatnonzero(tag == t) for t in np.unique(tag)]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        spread = z[rows].max(axis=0) - z[rows].min(axis=0)
        order = np.argsort(z[rows, int(np.argmax(spread))], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def nearby(x: np.ndarray, size: int = 128) -> np.ndarray:
    """Labels that rows close in space share, for ``reachable``."""
    label = np.zeros(len(x), dtype=np.int64)
    for i, rows in enumerate(_blocks(x, size)):
        label[rows] = i
    return label


def _touched(x: np.ndarray, limit: np.ndarray, boxes: Boxes, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) pairs that may be no further apart than the row's limit."""
    rows_out, boxes_out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for rows in _blocks(x, 256):
        has = ~np.isnan(x[rows])
        lower = box_bounds(x[rows].min(axis=0)[None], x[rows].max(axis=0)[None], has[:1], boxes, p)[0][0]
        near = np.flatnonzero(np.isfinite(lower) & (lower <= limit[rows].max()))
        step = max(1, 1_000_000 // max(1, len(near) * x.shape[1]))
        for s in range(0, len(rows) if len(near) else 0, step):
            part = rows[s : s + step]
            lower = box_bounds(x[part], x[part], has[s : s + step], _subset(boxes, near), p)[0]
            r, b = np.nonzero(np.isfinite(lower) & (lower <= limit[part][:, None]))
            rows_out.append(part[r])
            boxes_out.append(near[b])
    return np.concatenate(rows_out), np.concatenate(boxes_out)


def reachable_within(x: np.ndarray, limit: np.ndarray, cells: Boxes, boxes: Boxes, of_box: np.ndarray, k: int,
                     p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) pairs in which a donor within the row's limit may lie, and a bound per row that is no larger.

    ``limit`` is the distance of a row's k-th nearest donor so far. Rows that have none, or whose limit takes in many
    cells, are tested against the finer ``boxes`` too (of cell ``of_box``), which know bounds of their own.
    """
    bound = limit * (1 + SLACK) + NEAR
    known = np.flatnonzero(np.isfinite(limit))
    at, cell = _touched(x[known], bound[known], cells, p)
    at = known[at]
    vague = ~np.isfinite(limit) | (np.bincount(at, minlength=len(x)) > MANY_BOXES)
    if vague.any():
        rows = np.flatnonzero(vague)
        r, box, own = reachable(x[rows], boxes, k, p, [nearby(x[rows])], bound[rows])
        bound[rows] = np.minimum(bound[rows], own)
        sharp = ~vague[at]
        pairs = np.unique(np.column_stack([rows[r], of_box[box]]), axis=0)
        at, cell = np.r_[at[sharp], pairs[:, 0]], np.r_[cell[sharp], pairs[:, 1]]
    return at, cell, bound


def _box_table(x: np.ndarray, blocks: list[np.ndarray]) -> Boxes:
    return Boxes(np.stack([x[b].min(axis=0) for b in blocks]), np.stack([x[b].max(axis=0) for b in blocks]),
                 np.stack([~np.isnan(x[b[0]]) for b in blocks]), np.ones(len(blocks), dtype=bool),
                 np.array([len(b) for b in blocks]))


def squared_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    total, common = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        ok = ~np.isnan(diff)
        total += np.where(ok, diff * diff, 0.0)
        common += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total * (p / common), np.inf)


@dataclass(frozen=True)
class _Donors:
    """Donors in the order of their blocks, as queries of one pattern see them: no coordinate of theirs but the common ones."""
    at: np.ndarray       # positions in the table they came from
    x: list[np.ndarray]  # per coordinate that the queries have, gaps as 0
    has: list[np.ndarray | None]  # where the donors have it; None: all have it
    scale: np.ndarray    # p / common coordinates

    @staticmethod
    def of(donors: np.ndarray, order: np.ndarray, present: np.ndarray, p: int) -> _Donors:
        seen = donors[np.ix_(order, np.flatnonzero(present))]
        have = ~np.isnan(seen)
        common = have.sum(axis=1)
        z = np.nan_to_num(seen)
        return _Donors(order, [np.ascontiguousarray(z[:, j]) for j in range(z.shape[1])],
                       [None if have[:, j].all() else have[:, j].astype(float) for j in range(z.shape[1])],
                       p / np.maximum(common, 1))

    def distances(self, q: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(of)))
        for j, (x, has) in enumerate(zip(self.x, self.has)):
            diff = q[:, j, None] - x[of]
            diff *= diff
            if has is not None:
                diff *= has[of]
            total += diff
        total *= self.scale[of]
        return total


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


def _best(row: np.ndarray, at: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by (rounded distance, position), and their rank."""
    order = np.lexsort((at, np.round(d, DECIMALS), row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    keep = rank < k
    return row[keep], at[order][keep], d[order][keep], rank[keep]


@dataclass(frozen=True)
class _Tree:
    """Donors without gaps in the equal leaves of a balanced tree, some twice to make the leaves equal."""
    x: np.ndarray            # coordinate, leaf, donor
    at: np.ndarray           # leaf, donor: its position in the table it came from
    again: np.ndarray        # leaf, donor: infinity where it is the second of two, else 0
    axis: list[np.ndarray]   # per level, of every node
    cut: list[np.ndarray]
    low: list[np.ndarray]    # per level below the root: coordinate, node
    high: list[np.ndarray]

    @staticmethod
    def of(z: np.ndarray, at: np.ndarray, rows: int) -> _Tree:
        depth = max(0, int(np.ceil(np.log2(len(z) / rows))))
        more = -len(z) % 2**depth
        order = np.r_[np.arange(len(z)), np.arange(more) + len(z)][None]
        z, at = np.concatenate([z, z[:more]]), np.r_[at, at[:more]]
        again = np.r_[np.zeros(len(z) - more), np.full(more, np.inf)]
        axes, cuts, low, high = [], [], [], []
        for level in range(depth + 1):
            x = z[order]
            low.append(np.ascontiguousarray(x.min(axis=1).T))
            high.append(np.ascontiguousarray(x.max(axis=1).T))
            if level < depth:
                axes.append((high[-1] - low[-1]).argmax(axis=0))
                value = np.take_along_axis(x, axes[-1][:, None, None], axis=2)[:, :, 0]
                half = order.shape[1] // 2
                part = np.argpartition(value, half, axis=1)
                cuts.append(np.take_along_axis(value, part[:, half : half + 1], axis=1)[:, 0])
                order = np.take_along_axis(order, part, axis=1).reshape(-1, half)
        return _Tree(np.ascontiguousarray(np.moveaxis(z[order], 2, 0)), at[order], again[order], axes, cuts, low[1:], high[1:])

    def distances(self, q: np.ndarray, leaf: np.ndarray, scale: float) -> np.ndarray:
        total = self.again[leaf]
        for j in range(len(self.x)):
            diff = q[j][:, None] - self.x[j][leaf]
            diff *= diff
            total += diff
        total *= scale
        return total

    def search(self, q: np.ndarray, limit: np.ndarray, scale: float,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, distance, rank) of the k best donors of every query that are within its limit."""
        rows, home = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        for axis, cut in zip(self.axis, self.cut):
            home = 2 * home + (q[rows, axis[home]] >= cut[home])
        q = np.ascontiguousarray(q.T)
        if self.at.shape[1] >= k:
            kth = np.partition(self.distances(q, home, scale), k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, kth * (1 + SLACK) + NEAR)
        limit = np.minimum(limit, np.finfo(float).max)  # a donor that comes again is at infinity
        row, leaf, lower = rows, np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
        for low, high in zip(self.low, self.high):
            row, leaf = np.repeat(row, 2), (2 * leaf[:, None] + np.array([0, 1])).ravel()
            lower = np.zeros(len(row))
            for x, lo, hi in zip(q, low, high):
                x = x[row]
                off = np.maximum(np.maximum(lo[leaf] - x, x - hi[leaf]), 0.0)
                off *= off
                lower += off
            lower = lower * (scale * (1 - SLACK)) - SLACK
            near = lower <= limit[row]
            row, leaf, lower = row[near], leaf[near], lower[near]
        # the first few leaves by distance bring the limit down before anything is kept
        order = np.lexsort((lower, row))
        row, leaf, lower = row[order], leaf[order], lower[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        early = place < FIRST_LEAVES
        d = np.full((len(rows), FIRST_LEAVES, self.at.shape[1]), np.inf)
        d[row[early], place[early]] = self.distances(q[:, row[early]], leaf[early], scale)
        if d[0].size >= k:
            kth = np.partition(d.reshape(len(rows), -1), k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, kth * (1 + SLACK) + NEAR)
        near = lower <= limit[row]
        row, leaf = row[near], leaf[near]
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        step = max(1, 1_000_000 // self.at.shape[1])
        for s in range(0, len(row), step):
            r, n = row[s : s + step], leaf[s : s + step]
            d = self.distances(q[:, r], n, scale)
            i, j = np.nonzero(d <= limit[r][:, None])
            best = _best(np.r_[best[0], r[i]], np.r_[best[1], self.at[n[i], j]], np.r_[best[2], d[i, j]], k)
        return best


def _first_of_same(z: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that have fewer than ``k`` equal rows before them."""
    order = np.lexsort(z.T)
    first = np.flatnonzero(np.r_[True, (np.diff(z[order], axis=0) != 0).any(axis=1)])
    rank = np.arange(len(z)) - np.repeat(first, np.diff(np.r_[first, len(z)]))
    return np.sort(order[rank < k])


def _nearest_of_pattern(queries: np.ndarray, donors: np.ndarray, has: np.ndarray, k: int, p: int, bound: np.ndarray,
                        best_at: np.ndarray, best_d: np.ndarray) -> None:
    """``nearest`` where all donors have the coordinates ``has``: a tree for each set of coordinates that queries share with them."""
    shared = ~np.isnan(queries) & has
    sets, which = np.unique(shared, axis=0, return_inverse=True)
    for i, common in enumerate(sets):
        if not common.any():
            continue
        z = donors[:, common]
        kept = np.arange(len(z)) if common.sum() == has.sum() else _first_of_same(z, k)
        leaf_rows = max(LEAF_ROWS, 4 * k)
        tree, scale = _Tree.of(z[kept], kept, leaf_rows), p / common.sum()
        rows, step = np.flatnonzero(which.ravel() == i), max(16, min(QUERY_ROWS, 1_000_000 // leaf_rows))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            row, at, dist, rank = tree.search(queries[part][:, common], bound[part], scale, k)
            best_at[part[row], rank], best_d[part[row], rank] = at, dist


def nearest(queries: np.ndarray, donors: np.ndarray, k: int, p: int, bound: np.ndarray | None = None,
            block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest donors of each query, ordered by (rounded distance, donor position).

    Returns (positions, squared distances), with position -1 where there are fewer than k. With a
    ``bound`` per query, donors beyond it need not be reported. Donors of one pattern are searched by a tree; of
    several, blocks of queries meet blocks of donors from the nearest on. Only distances within what is known of
    the k-th are kept and sorted.
    """
    best_at = np.full((len(queries), k), -1, dtype=np.int64)
    best_d = np.full((len(queries), k), np.inf)
    if not len(queries) or not len(donors):
        return best_at, best_d
    if bound is None:
        bound = np.full(len(queries), np.inf)
    bound = bound * (1 + SLACK) + SLACK
    have = ~np.isnan(donors)
    if (have == have[0]).all():
        _nearest_of_pattern(queries, donors, have[0], k, p, bound, best_at, best_d)
        return best_at, best_d
    blocks = _blocks(donors, block // 2)
    boxes = _box_table(donors, blocks)
    size = boxes.count
    start, in_order, views = np.cumsum(size) - size, np.concatenate(blocks), {}
    for rows in _blocks(queries, block):
        present = ~np.isnan(queries[rows[0]])
        if present.tobytes() not in views:
            views[present.tobytes()] = _Donors.of(donors, in_order, present, p)
        view, q = views[present.tobytes()], queries[rows][:, present]
        lower = box_bounds(queries[rows].min(axis=0)[None], queries[rows].max(axis=0)[None], present[None], boxes, p)[0][0]
        limit = bound[rows]
        near = np.flatnonzero(np.isfinite(lower) & (lower <= limit.max()))
        near = near[np.argsort(lower[near], kind="stable")]
        row = at = rank = np.zeros(0, dtype=np.int64)
        dist = np.zeros(0)
        done, want = 0, max(2 * k, block)
        while done < len(near) and lower[near[done]] <= limit.max():
            take = near[done : done + max(1, int(np.searchsorted(np.cumsum(size[near[done:]]), want)))]
            take = take[lower[take] <= limit.max()]
            of = _ranges(start[take], size[take])
            for s in range(0, len(of), max(1, 1_000_000 // len(rows))):
                part = of[s : s + max(1, 1_000_000 // len(rows))]
                d = view.distances(q, part)
                if len(part) > k:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + SLACK) + NEAR)
                i, j = np.nonzero(d <= limit[:, None])
                row, at, dist, rank = _best(np.r_[row, i], np.r_[at, view.at[part[j]]], np.r_[dist, d[i, j]], k)
                full = rank == k - 1
                limit[row[full]] = np.minimum(limit[row[full]], dist[full] * (1 + SLACK) + NEAR)
            done += len(take)
            want *= 2
        fits = dist <= bound[rows[row]]
        best_at[rows[row[fits]], rank[fits]] = at[fits]
        best_d[rows[row], rank] = dist
    return best_at, best_d
