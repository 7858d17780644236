"""Many rings at once in flat arrays: cut, measured and thinned together, by the rules for one ring.

A batch of rings is its points one after another (n, 2) and their starts (rings + 1). Every step is a
few array operations over all points of the batch, however many rings they belong to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Rings:
    """Points of rings one after another; starts[i] to starts[i + 1] are ring i's."""

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray):
        self.x, self.y, self.starts = x, y, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        """Each point's ring."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def following(self) -> np.ndarray:
        """Each point's next one in its ring, the first after the last."""
        nxt = np.arange(1, len(self.x) + 1)
        full = self.sizes > 0
        nxt[self.starts[1:][full] - 1] = self.starts[:-1][full]
        return nxt

    def take(self, at: np.ndarray) -> Rings:
        """Rings by number, in that order, any of them more than once."""
        size = self.sizes[at]
        starts = np.concatenate(([0], np.cumsum(size)))
        points = np.repeat(self.starts[:-1][at] - starts[:-1], size) + np.arange(starts[-1])
        return Rings(self.x[points], self.y[points], starts)

    def kept(self, points: np.ndarray) -> Rings:
        """The rings with only the points of a mask."""
        starts = np.concatenate(([0], np.cumsum(points)))[self.starts]
        return Rings(self.x[points], self.y[points], starts)

    def low_high(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Boxes (x0, y0, x1, y1); of an empty ring inverted ones."""
        full = self.sizes > 0
        out = [np.full(len(self), v) for v in (np.inf, np.inf, -np.inf, -np.inf)]
        if full.any():
            at = self.starts[:-1][full]
            for o, f, v in zip(out, (np.minimum, np.minimum, np.maximum, np.maximum), (self.x, self.y, self.x, self.y)):
                o[full] = f.reduceat(v, at)
        return tuple(out)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the points' values by ring."""
        out, full = np.zeros(len(self)), self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(values, self.starts[:-1][full])
        return out

    def areas(self) -> np.ndarray:
        """Signed areas, about each ring's first point."""
        full = self.sizes > 0
        first = np.repeat(self.starts[:-1][full], self.sizes[full])
        x, y = self.x - self.x[first], self.y - self.y[first]
        n = self.following()
        return self.sums(x * y[n] - x[n] * y) / 2


def cut(r: Rings, axis: int, bound: np.ndarray, sign: int) -> Rings:
    """Each ring cut to one side of its line (bound), by Sutherland and Hodgman's rule; points on the line stay."""
    own, nxt = r.owner, r.following()
    b = bound[own]
    d = sign * ((r.y if axis else r.x) - b)
    dn = d[nxt]
    cross = d * dn < 0
    t = np.where(cross, d / np.where(cross, d - dn, 1.0), 0.0)
    mx, my = r.x + (r.x[nxt] - r.x) * t, r.y + (r.y[nxt] - r.y) * t
    if axis:
        my = b
    else:
        mx = b
    keep = np.stack((d >= 0, cross), axis=1).reshape(-1)
    x, y = np.stack((r.x, mx), axis=1).reshape(-1)[keep], np.stack((r.y, my), axis=1).reshape(-1)[keep]
    starts = np.concatenate(([0], np.cumsum(keep)))[2 * r.starts]
    return Rings(x, y, starts)


def sided(r: Rings, axis: int, bound: np.ndarray, sign: int) -> Rings:
    """cut(), but only of the rings that their line crosses: others are taken whole, or nothing of them."""
    x0, y0, x1, y1 = r.low_high()
    low, high = (y0, y1) if axis else (x0, x1)
    whole = low >= bound if sign > 0 else high <= bound
    none = high <= bound if sign > 0 else low >= bound
    split = np.flatnonzero(~whole & ~none)
    if not len(split) and not none.any():
        return r
    done = cut(r.take(split), axis, bound[split], sign)
    return merged(len(r), [(np.flatnonzero(whole), r.take(np.flatnonzero(whole))), (split, done)])


def merged(n: int, parts: list[tuple[np.ndarray, Rings]]) -> Rings:
    """n rings from parts (their numbers, the rings); those of no part are empty."""
    size = np.zeros(n, np.int64)
    for at, r in parts:
        size[at] = r.sizes
    starts = np.concatenate(([0], np.cumsum(size)))
    x, y = np.empty(starts[-1]), np.empty(starts[-1])
    for at, r in parts:
        to = np.repeat(starts[:-1][at] - r.starts[:-1], r.sizes) + np.arange(len(r.x))
        x[to], y[to] = r.x, r.y
    return Rings(x, y, starts)


def thinned(r: Rings, eps: np.ndarray) -> np.ndarray:
    """Which points geom.thin() keeps of each line, by each line's eps: all stretches of a depth are tried at once.

    A stretch keeps its farthest inner point, the first of equal ones, if that is strictly beyond eps.
    """
    keep = np.zeros(len(r.x), bool)
    full = np.flatnonzero(r.sizes > 0)
    keep[r.starts[:-1][full]] = True
    keep[r.starts[1:][full] - 1] = True
    a, b, e = r.starts[:-1][full], r.starts[1:][full] - 1, eps[full]
    while True:
        long = b - a > 1
        a, b, e = a[long], b[long], e[long]
        if not len(a):
            return keep
        size = b - a - 1
        begins = np.concatenate(([0], np.cumsum(size)))
        own = np.repeat(np.arange(len(a)), size)
        at = np.repeat(a + 1 - begins[:-1], size) + np.arange(begins[-1])
        px, py = r.x[a], r.y[a]
        dx, dy = r.x[b] - px, r.y[b] - py
        length = dx * dx + dy * dy
        mx, my = r.x[at], r.y[at]
        px, py, dx, dy, length = px[own], py[own], dx[own], dy[own], length[own]
        t = np.where(length == 0, 0.0, np.clip(((mx - px) * dx + (my - py) * dy) / np.where(length == 0, 1.0, length), 0.0, 1.0))
        ox, oy = mx - (px + t * dx), my - (py + t * dy)
        dist = np.sqrt(ox * ox + oy * oy)
        most = np.maximum.reduceat(dist, begins[:-1])
        ties = np.flatnonzero(dist == most[own])
        first = ties[np.concatenate(([True], own[ties][1:] != own[ties][:-1]))]
        beyond = most > e
        split = at[first[beyond]]
        keep[split] = True
        a, b, e = np.concatenate((a[beyond], split)), np.concatenate((split, b[beyond])), np.concatenate((e[beyond], e[beyond]))


def joined(parts: list[Rings]) -> Rings:
    """Rings of several as one, in that order."""
    sizes = np.concatenate([p.sizes for p in parts])
    return Rings(np.concatenate([p.x for p in parts]), np.concatenate([p.y for p in parts]), np.concatenate(([0], np.cumsum(sizes))))


def closed(r: Rings) -> Rings:
    """Each ring with its first point again at its end."""
    size = r.sizes + (r.sizes > 0)
    starts = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(r.starts[:-1] - starts[:-1], size) + np.arange(starts[-1])
    full = r.sizes > 0
    at[starts[1:][full] - 1] = r.starts[:-1][full]
    return Rings(r.x[at], r.y[at], starts)


def of_lists(xs: pa.ListArray, ys: pa.ListArray) -> Rings:
    """Rings of two list columns."""
    x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for c in (xs, ys))
    starts = np.asarray(xs.offsets, np.int64)
    return Rings(x, y, starts - starts[0])


def lists(r: Rings) -> tuple[pa.ListArray, pa.ListArray]:
    """The two list columns of rings."""
    ends = pa.array(r.starts.astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(r.x)), pa.ListArray.from_arrays(ends, pa.array(r.y))
