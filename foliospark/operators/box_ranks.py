"""Reading positions in many small groups of boxes at once, by the rule of ``reading_order.rank_boxes``.

Boxes of a group cover at most a few hundred cells of the grid's lines, so the painted grid is kept by segments between
box edges, in which nothing changes. All regions of one depth, of all groups, are cut together by numpy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

GRID = 100  # fixed value: cells along the longer side
CELLS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 20


def ranks(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each box in its group. Boxes lie group by group, ``sizes`` each; their order decides ties."""
    out, first = np.zeros(len(x), np.int64), np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 1]  # a box alone needs no cutting
    at = 0
    while at < len(order):
        segments = min(GRID + 1, 2 * int(2 ** np.ceil(np.log2(sizes[order[at]]))) + 1)
        upto = np.searchsorted(sizes[order], max(2, (segments - 1) // 2), "right") if segments <= GRID else len(order)
        upto = min(upto, at + max(1, CELLS_AT_ONCE // segments**2))
        some = order[at:upto]
        n = sizes[some]
        group = np.repeat(np.arange(len(some)), n)
        rows = first[some][group] + np.arange(len(group)) - (np.cumsum(n) - n)[group]
        out[rows] = _ranked(group, n, x[rows], y[rows], w[rows], h[rows])
        at = upto
    return out


def _ranked(group: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    heads = np.cumsum(n) - n
    left, top = np.minimum.reduceat(x, heads), np.minimum.reduceat(y, heads)
    wide, high = np.maximum.reduceat(x + w, heads) - left, np.maximum.reduceat(y + h, heads) - top
    portrait, flat = high >= wide, (wide == 0) | (high == 0)
    safe_w, safe_h = np.where(wide == 0, 1.0, wide), np.where(high == 0, 1.0, high)
    full = float(GRID)
    gx, gy = np.where(portrait, full * (wide / safe_h), full), np.where(portrait, full, full * (high / safe_w))
    cols, rows = (np.where(flat, 2, np.ceil(np.where(flat, 1, g)) + 1).astype(np.int64) for g in (gx, gy))

    def along(low, size, origin, grid, extent, cells):
        ratio = lambda v: (v - origin[group]) * grid[group] / extent[group]
        a = np.maximum(0, np.floor(ratio(low)))
        b = np.minimum(cells[group] - 1, np.ceil(ratio(low + size)))
        return np.where(flat[group], 0, a).astype(np.int64), np.where(flat[group], 1, np.maximum(a + 1, b)).astype(np.int64)

    x0, x1 = along(x, w, left, gx, safe_w, cols)
    y0, y1 = along(y, h, top, gy, safe_h, rows)
    tree = _cut(group, x0, y0, x1, y1, cols, rows)
    leaf = _best_leaf(tree, group, x0, y0, x1, y1)
    place, upright = _read(tree, leaf, (x1 - x0) < (y1 - y0))
    one, two = np.where(upright, -x0, y0), np.where(upright, y0, x0)
    order = np.lexsort((two, one, place, group))  # stable, so the given order decides ties
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - heads[group]
    return out


class _Tree(NamedTuple):
    """Regions of all groups, depth by depth; the children of a region lie beside each other."""

    levels: list[tuple[int, int]]  # first and last number
    owner: np.ndarray
    parent: np.ndarray
    sideways: np.ndarray  # cut from left to right
    leaves: np.ndarray  # number of leaves below
    area: tuple[np.ndarray, ...]  # x0, y0, x1, y1 in cells

    def starts(self, turned: np.ndarray) -> np.ndarray:
        """Number of leaves of the group before each region, where the children of ``turned`` regions come in reverse."""
        out = np.zeros(len(self.owner), np.int64)
        for a, b in self.levels[1:]:
            parent, count = self.parent[a:b], self.leaves[a:b]
            before = np.cumsum(count) - count
            before -= before[np.searchsorted(parent, parent)]
            out[a:b] = out[parent] + np.where(turned[parent], self.leaves[parent] - before - count, before)
        return out

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Adds the values of the leaves to all regions above."""
        for a, b in self.levels[:0:-1]:
            values += np.bincount(self.parent[a:b], values[a:b], len(values)).astype(np.int64)
        return values


def _segments(group: np.ndarray, low: np.ndarray, high: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of segments per group (padded by the last one), their number, and the segments of each box."""
    groups, n, base = np.arange(len(cells)), len(low), GRID + 3
    code = np.concatenate([group, group, groups, groups]) * base + np.concatenate([low, high, 0 * groups, cells])
    found, place = np.unique(code, return_inverse=True)
    owner = found // base
    first = np.searchsorted(owner, groups)
    count = np.diff(np.append(first, len(found))) - 1
    edges = np.repeat(cells[:, None], count.max() + 1, 1)
    edges[owner, np.arange(len(found)) - first[owner]] = found % base
    return edges, count, place[:n] - first[group], place[n : 2 * n] - first[group]


def _valley(profile: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last segment, length and depth of the longest run of the least value from a to b (the first one on ties)."""
    at = np.arange(profile.shape[1])
    inside = (at >= a[:, None]) & (at < b[:, None])
    low = np.where(inside, profile, np.iinfo(np.int64).max).min(1)
    high = np.where(inside, profile, -1).max(1)
    hit = inside & (profile == low[:, None])
    run, start, best, first, last = (np.zeros(len(a), np.int64) for _ in range(5))
    for j in at:
        start = np.where(hit[:, j] & (run == 0), j, start)
        run = np.where(hit[:, j], run + lengths[:, j], 0)
        longer = run > best
        best, first, last = np.where(longer, run, best), np.where(longer, start, first), np.where(longer, j + 1, last)
    single = np.where(inside, lengths, 0).sum(1) <= 1  # one cell has no depth
    return first, last, best, np.where(single | (high == 0), 0.0, -low / np.maximum(high, 1))


def _cut(group, x0, y0, x1, y1, cols, rows) -> _Tree:
    ex, nx, xa, xb = _segments(group, x0, np.minimum(x1, cols[group]), cols)
    ey, ny, ya, yb = _segments(group, y0, np.minimum(y1, rows[group]), rows)
    dx, dy = np.diff(ex), np.diff(ey)
    shape = (len(cols), dy.shape[1] + 1, dx.shape[1] + 1)
    corner = lambda i, j: np.ravel_multi_index((group, i, j), shape)
    ends = np.bincount(np.concatenate([corner(ya, xa), corner(yb, xb)]), minlength=np.prod(shape))
    ends -= np.bincount(np.concatenate([corner(ya, xb), corner(yb, xa)]), minlength=np.prod(shape))
    painted = (ends.reshape(shape).cumsum(1).cumsum(2) > 0)[:, :-1, :-1]
    # cells painted above each edge, and left of each edge
    above, before = (np.zeros(s, np.int64) for s in ((shape[0], shape[1], shape[2] - 1), (shape[0], shape[1] - 1, shape[2])))
    np.cumsum(painted * dy[:, :, None], axis=1, out=above[:, 1:])
    np.cumsum(painted * dx[:, None, :], axis=2, out=before[:, :, 1:])

    owner, zero = np.arange(len(cols)), np.zeros(len(cols), np.int64)
    box, parent, blank = np.stack([zero, zero, nx, ny]), zero - 1, zero > 0
    levels, done, total = [], [], 0
    while len(owner):
        a0, b0, a1, b1 = box
        area = ex[owner, a0], ey[owner, b0], ex[owner, a1], ey[owner, b1]
        sideways = np.zeros(len(owner), bool)
        levels.append((total, total + len(owner)))
        done.append((owner, parent, sideways, *area))
        live = np.flatnonzero(~blank)
        ink = before[owner[live], :, a1[live]] - before[owner[live], :, a0[live]]
        at = np.arange(ink.shape[1])
        full = np.where((at >= b0[live][:, None]) & (at < b1[live][:, None]), ink * dy[owner[live]], 0).sum(1)
        # even areas have no valley
        cut = (full > 0) & (full < ((area[2] - area[0]) * (area[3] - area[1]))[live])
        some, down = live[cut], ink[cut]
        o, p, q, r, s = owner[some], a0[some], b0[some], a1[some], b1[some]
        fx, lx, length_x, depth_x = _valley(above[o, s] - above[o, q], dx[o], p, r)
        fy, ly, length_y, depth_y = _valley(down, dy[o], q, s)
        # The axis whose valley is nearer to empty is cut; on equal depth the longer valley, then left-right.
        across = (depth_y < depth_x) | ((depth_y == depth_x) & (length_x >= length_y))
        stops = np.where(across, np.stack([p, fx, lx, r]), np.stack([q, fy, ly, s]))
        kept = (stops[:-1] < stops[1:]).T
        kept &= kept.sum(1, keepdims=True) > 1  # else nothing was cut off
        sideways[some] = across
        node, part = np.nonzero(kept)
        low, high, lie = stops[part, node], stops[part + 1, node], across[node]
        blank = (part == 1) & (np.where(across, depth_x, depth_y)[node] == 0)
        box = np.stack([np.where(lie, low, p[node]), np.where(lie, q[node], low), np.where(lie, high, r[node]), np.where(lie, s[node], high)])
        owner, parent, total = o[node], total + some[node], levels[-1][1]
    owner, parent, sideways, *area = (np.concatenate(c) for c in zip(*done))
    tree = _Tree(levels, owner, parent, sideways, np.ones(len(owner), np.int64), tuple(area))
    tree.leaves[parent[parent >= 0]] = 0
    tree.summed(tree.leaves)
    return tree


def _best_leaf(tree: _Tree, group, x0, y0, x1, y1) -> np.ndarray:
    """The first leaf with the highest overlap (intersection over union) of each box, the first of all without any."""
    count = tree.leaves[: len(tree.leaves[slice(*tree.levels[0])])]
    base = np.cumsum(count) - count
    bottom = np.ones(len(tree.owner), bool)
    bottom[tree.parent[tree.parent >= 0]] = False
    number = np.flatnonzero(bottom)
    listed = np.empty(len(number), np.int64)
    listed[base[tree.owner[number]] + tree.starts(np.zeros(len(tree.owner), bool))[number]] = number
    lx0, ly0, lx1, ly1 = (side[listed] for side in tree.area)
    best, many = np.empty(len(group), np.int64), count[group]
    ends = np.cumsum(many)
    at = 0
    while at < len(group):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = many[at:upto]
        heads = np.cumsum(n) - n
        b = np.repeat(np.arange(at, upto), n)
        leaf = base[group[b]] + np.arange(len(b)) - np.repeat(heads, n)
        common = np.maximum(0, np.minimum(x1[b], lx1[leaf]) - np.maximum(x0[b], lx0[leaf])) * np.maximum(0, np.minimum(y1[b], ly1[leaf]) - np.maximum(y0[b], ly0[leaf]))
        union = (x1[b] - x0[b]) * (y1[b] - y0[b]) + (lx1[leaf] - lx0[leaf]) * (ly1[leaf] - ly0[leaf]) - common
        share = np.where(common > 0, common / union, -1.0)
        top = np.repeat(np.maximum.reduceat(share, heads), n)
        best[at:upto] = np.minimum.reduceat(np.where(share == top, leaf, len(listed)), heads)
        at = upto
    return listed[best]


def _read(tree: _Tree, leaf: np.ndarray, tall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reading position of the leaf of each box, and whether its boxes are upright."""
    n = len(tree.owner)
    total, upright = tree.summed(np.bincount(leaf, minlength=n)), tree.summed(np.bincount(leaf[tall], minlength=n))
    turned = total < 2 * upright
    # Below a left-right cut, upright text is read from right to left.
    return tree.starts(turned & tree.sideways)[leaf], turned[leaf]
