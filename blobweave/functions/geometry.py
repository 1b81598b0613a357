"""Bounding and inscribed figures of one region, from its runs sorted by (r, c0).

Distances between pixels are taken at their centres; hull areas, rectangles and the
enclosing circle at their corners, so that a filled box is its own hull.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ..operators.regions import by_region, filled, touching

Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


def hull(points: np.ndarray) -> np.ndarray:
    """Strict convex hull of distinct integer points (r, c), in one turning sense."""
    rows = sorted(set(map(tuple, points.tolist())))
    if len(rows) < 3:
        return np.array(rows)

    def chain(seq: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def row_ends(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> Arrays:
    """First and last column of each row that the region has."""
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return r[first], np.minimum.reduceat(c0, first), np.maximum.reduceat(c1, first)


def corner_hull(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Hull of the pixels' corners; (0, 0) is the upper left corner of pixel (0, 0)."""
    r, a, b = row_ends(r, c0, c1)
    return hull(np.concatenate([np.column_stack(x) for x in ((r, a), (r, b + 1), (r + 1, a), (r + 1, b + 1))]))


def polygon_area(h: np.ndarray) -> float:
    r, c = h[:, 0], h[:, 1]
    return abs(int(r @ np.roll(c, -1)) - int(c @ np.roll(r, -1))) / 2


def antipodes(h: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of hull vertices with parallel lines of support, by rotating calipers; every farthest pair is among them."""
    n = len(h)
    if n < 3:
        return [(i, j) for i in range(n) for j in range(i, n)]
    p = h.tolist()

    def height(i: int, j: int) -> int:  # of vertex j above the edge from i on
        (r1, c1), (r2, c2), (r, c) = p[i], p[(i + 1) % n], p[j % n]
        return abs((r2 - r1) * (c - c1) - (c2 - c1) * (r - r1))

    pairs, j = [], 1
    for i in range(n):
        j = max(j, i + 1)
        while height(i, j + 1) > height(i, j):
            pairs += [(i, j), (i + 1, j)]
            j += 1
        pairs += [(i, j), (i + 1, j)]
        if height(i, j + 1) == height(i, j):  # an edge against an edge
            pairs += [(i, j + 1), (i + 1, j + 1)]
    return [(i % n, j % n) for i, j in pairs]


def centre_hull(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Hull of the pixels' centres."""
    r, a, b = row_ends(r, c0, c1)
    return hull(np.concatenate([np.column_stack((r, a)), np.column_stack((r, b))]))


def diameter(h: np.ndarray) -> tuple:
    """Largest distance of two pixel centres of a hull and their places; of several the smallest (r1, c1, r2, c2)."""
    i, j = np.array(antipodes(h)).T
    d2 = ((h[i] - h[j]) ** 2).sum(1)
    far = d2 == d2.max()
    ends = min(sum(sorted((p, q)), ()) for p, q in zip(map(tuple, h[i[far]].tolist()), map(tuple, h[j[far]].tolist()), strict=True))
    return math.sqrt(int(d2.max())), *ends


def rectangle2(h: np.ndarray) -> tuple[float, float, float, float, float]:
    """Smallest rotated rectangle: centre row and column (of pixels), angle of the long side, half-lengths.

    It lies on an edge of the hull.  Of equal areas the longer one wins, then the
    smallest angle in (-pi/2, pi/2]; a square's angle is that in (-pi/4, pi/4].
    """
    dr, dc = (np.roll(h, -1, axis=0) - h).T
    length = np.hypot(dr, dc)
    # the vertices that are farthest along an edge, across it, and against both, by the turning angle of the edges
    turn = np.unwrap(np.arctan2(dc, dr))
    sense = 1 if turn[-1] >= turn[0] else -1
    turn = turn * sense

    def reach(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The largest product of a vertex with each direction."""
        at = np.searchsorted(turn, turn[0] + np.mod(np.arctan2(c, r) * sense + np.pi / 2 - turn[0], 2 * np.pi))
        return np.max([h[(at + k) % len(h), 0] * r + h[(at + k) % len(h), 1] * c for k in (-1, 0, 1)], axis=0)

    u0, u1, v0, v1 = (x / length for x in (-reach(-dr, -dc), reach(dr, dc), -reach(dc, -dr), reach(-dc, dr)))
    e, f, phi = u1 - u0, v1 - v0, np.arctan2(-dr, dc)
    square = np.abs(e - f) <= 1e-9
    period = np.where(square, np.pi / 2, np.pi)
    phi = np.where(square | (e > f), phi, phi + np.pi / 2)
    phi = phi - period * np.ceil((phi - period / 2 - 1e-9) / period)
    k = np.lexsort((np.round(phi, 9), -np.round(np.maximum(e, f), 9), np.round(e * f, 9)))[0]
    u, v = (u0[k] + u1[k]) / 2, (v0[k] + v1[k]) / 2
    return float((u * dr[k] - v * dc[k]) / length[k] - 0.5), float((u * dc[k] + v * dr[k]) / length[k] - 0.5), float(phi[k]), float(max(e[k], f[k]) / 2), float(min(e[k], f[k]) / 2)


def enclosing_circle(h: np.ndarray) -> tuple[float, float, float]:
    """Smallest circle about the corners: centre row and column (of pixels), radius."""
    points = h[np.random.default_rng(0).permutation(len(h))].astype(float)

    def two(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
        return (p + q) / 2, math.dist(p, q) / 2

    def three(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
        m = 2 * np.array([q - p, s - p])
        centre = p + np.linalg.solve(m, ((np.array([q, s]) - p) ** 2).sum(1))
        return centre, math.dist(centre, p)

    def outside(circle: tuple[np.ndarray, float], upto: int) -> int | None:
        far = np.flatnonzero(((points[:upto] - circle[0]) ** 2).sum(1) > (circle[1] * (1 + 1e-12)) ** 2 + 1e-12)
        return int(far[0]) if len(far) else None

    # move-to-front in order: each point outside must be on the circle of those before it
    circle, i = (points[0], 0.0), 0
    while (i := outside(circle, len(points))) is not None:
        circle = (points[i], 0.0)
        while (j := outside(circle, i)) is not None:
            circle = two(points[i], points[j])
            while (k := outside(circle, j)) is not None:
                circle = three(points[i], points[j], points[k])
    return float(circle[0][0]) - 0.5, float(circle[0][1]) - 0.5, circle[1]


class Pixels:
    """The pixels of a region in order, with their run and how far up and down the region goes on; memory grows with the area, not with the box.

    Of a band of a region, ``above`` and ``below`` tell by column how far it goes on beyond the first and the last
    row of the band, ``ends``.
    """

    def __init__(self, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, ends: tuple[int, int] | None = None, above: Beyond | None = None, below: Beyond | None = None):
        n = c1 - c0 + 1
        self.first = np.cumsum(n) - n
        self.run = np.repeat(np.arange(len(r)), n)
        self.r = r[self.run]
        self.c = np.arange(n.sum()) - self.first[self.run] + c0[self.run]
        self.c0, self.c1 = c0[self.run], c1[self.run]
        order = np.lexsort((self.r, self.c))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.c[order]) != 0) | (np.diff(self.r[order]) != 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        place = np.arange(len(order)) - np.repeat(first, size)
        self.up, self.down = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.up[order], self.down[order] = place + 1, np.repeat(size, size) - place
        if ends is not None:
            self.up += _beyond(above, self.c, self.r - self.up + 1 == ends[0])
            self.down += _beyond(below, self.c, self.r + self.down - 1 == ends[1])


#: Columns in order and how many more pixels each has.
Beyond = tuple[np.ndarray, np.ndarray]


def _beyond(told: Beyond | None, c: np.ndarray, at_seam: np.ndarray) -> np.ndarray | int:
    if told is None or not len(told[0]):
        return 0
    at = np.minimum(np.searchsorted(told[0], c), len(told[0]) - 1)
    return np.where(at_seam & (told[0][at] == c), told[1][at], 0)


def _rows_alike(size: np.ndarray) -> list[np.ndarray]:
    """Indices of rows by falling size, in groups in which none is more than twice as long as another."""
    order = np.argsort(-size, kind="stable")
    cuts = np.flatnonzero(np.diff(np.frexp(size[order].astype(float))[1])) + 1
    return [g for g in np.split(order, cuts) if len(g)]


def squared_distance(p: Pixels, chosen: np.ndarray | None = None) -> np.ndarray:
    """Exact squared distance of each pixel to the background; with ``chosen`` only of those of these runs, zero of others.

    That is the least, over the pixels of its run and the ends of it, of the square of the way along and that of the
    way up or down from there.  The lower envelope of these parabolas is found from left to right by a stack and read
    from right to left, in time that is linear in the pixels; runs go side by side.  A run that is much longer than
    the ways up and down are is taken in parts that overlap by as much as those reach.
    """
    column = np.minimum(p.up, p.down)
    out = np.zeros(len(column), np.int64)
    size = np.diff(np.append(p.first, len(column)))
    reach = np.maximum.reduceat(column, p.first)
    step = np.maximum(reach, 64)
    chosen = np.arange(len(size)) if chosen is None else chosen
    parts = -(-size[chosen] // step[chosen])
    run = np.repeat(chosen, parts)
    begin = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * step[run]  # of the core, in its run
    low, high = np.maximum(begin - reach[run], 0) - 1, np.minimum(begin + step[run] + reach[run], size[run]) + 1
    # a place beyond each end stands for the background there, or for what reaches no further
    for group in _rows_alike(high - low):
        base, width = (p.first[run[group]] + low[group])[:, None], high[group] - low[group]
        place = np.arange(int(width[0]))
        inside = (place > 0) & (place < width[:, None] - 1)
        square = np.where(inside, column[np.clip(base + place, 0, len(column) - 1)], 0) ** 2
        for edge, past in ((0, low[group] >= 0), (width - 1, high[group] <= size[run[group]])):
            square[np.flatnonzero(past), np.broadcast_to(edge, width.shape)[past]] = reach.max() ** 2 + 1 + int(width[0]) ** 2
        nearest = _lower_envelope(square, width)
        core = inside & (base + place >= (p.first[run[group]] + begin[group])[:, None]) & (base + place < (p.first[run[group]] + np.minimum(begin[group] + step[run[group]], size[run[group]]))[:, None])
        out[(base + place)[core]] = nearest[core]
    return out


def _lower_envelope(square: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The least of (x - i) ** 2 + square[row, i] over i < width[row], for each x; rows by falling width."""
    rows = len(square)
    top = np.zeros(rows, np.int64)  # of each row's stack
    owner, since = np.zeros_like(square), np.zeros_like(square)  # whose parabola is lowest from where on
    each = np.arange(rows)

    def at(row: np.ndarray, i: np.ndarray, x: np.ndarray | int) -> np.ndarray:
        return (x - i) ** 2 + square[row, i]

    for x in range(1, int(width[0])):
        row = each[: int(np.searchsorted(-width, -x))]  # those that are longer than x
        own = square[row, x]
        todo = row
        while len(todo):
            k = top[todo]
            worse = at(todo, owner[todo, k], since[todo, k]) > at(todo, np.full(len(todo), x), since[todo, k])
            todo = todo[worse]
            top[todo] -= 1
            todo = todo[top[todo] >= 0]
        gone = row[top[row] < 0]
        top[gone], owner[gone, 0], since[gone, 0] = 0, x, 0
        rest = row[owner[row, top[row]] != x]
        i = owner[rest, top[rest]]
        begin = 1 + (x * x - i * i + own[rest] - square[rest, i]) // (2 * (x - i))
        on = begin < width[rest]
        rest, begin = rest[on], begin[on]
        top[rest] += 1
        owner[rest, top[rest]], since[rest, top[rest]] = x, begin
    out = np.zeros_like(square)
    for x in range(int(width[0]) - 1, -1, -1):
        row = each[: int(np.searchsorted(-width, -x))]
        k = top[row]
        out[row, x] = at(row, owner[row, k], x)
        top[row] -= (since[row, k] == x) & (k > 0)
    return out


def inner_circle(p: Pixels) -> tuple[int, int, int]:
    """Squared radius and centre of the largest circle about a pixel up to the background; of several the first in (r, c).

    Runs are taken, more and more at once, by what the ways up, down and to their ends allow, while that is no less than the best found.
    """
    least = np.minimum(np.minimum(p.up, p.down), np.minimum(p.c - p.c0, p.c1 - p.c) + 1)
    most = np.maximum.reduceat(least, p.first) ** 2
    if most.max() == 1:  # every pixel has the background next to it
        return 1, int(p.r[0]), int(p.c[0])
    order = np.argsort(-most, kind="stable")
    best, at = (0, 0), 0
    while at < len(order) and most[order[at]] >= best[0]:
        take = order[at : at + max(64, at)]
        d2 = squared_distance(p, take)
        i = int(np.argmax(d2))
        best = max(best, (int(d2[i]), -i))
        at += len(take)
    return best[0], int(p.r[-best[1]]), int(p.c[-best[1]])


def circle_figures(d2: int, r: int, c: int) -> tuple[int, int, float]:
    """Centre and radius of the inscribed circle, which ends at the edge of the nearest background pixel."""
    return r, c, math.sqrt(d2) - 0.5


def inner_rectangle(p: Pixels) -> tuple[int, int, int, int, int]:
    """Size and (r1, c1, r2, c2) of the largest inscribed upright rectangle; of several the smallest.

    A rectangle that can't grow stands on a row, under the height of one of its stretches of equal heights, and
    reaches as far as heights are not lower.  How far that is, is found by doubling steps over the lowest heights
    of 1, 2, 4, ... stretches, for those that may hold a rectangle as large as one found at first.
    """
    new = np.ones(len(p.c), bool)
    new[1:] = (np.diff(p.up) != 0) | (np.diff(p.run) != 0)
    start = np.flatnonzero(new)
    run, tall, r = p.run[start], p.up[start], p.r[start]
    left, right = p.c[start], p.c[np.append(start[1:], len(p.c)) - 1]
    whole = np.append(np.flatnonzero(np.append(True, np.diff(run) != 0)), len(run))
    low = np.minimum.reduceat(tall, whole[:-1])
    length = (p.c1 - p.c0 + 1)[start]
    least = max(int((tall * (right - left + 1)).max()), int((low * length[whole[:-1]]).max()))
    able = np.flatnonzero(tall * length >= least)
    # a stretch of no height stands between runs, and many of them at both ends
    table = np.zeros(len(tall) + len(whole) + 1, np.int64)
    place = np.arange(len(tall)) + 1 + np.repeat(np.arange(len(whole) - 1), np.diff(whole))
    table[place] = tall
    levels = [table]
    longest = int(np.diff(whole).max())
    while 1 << len(levels) <= longest:
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last, np.concatenate([last[half:], np.zeros(half, np.int64)])))  # of those from here on
    index = np.full(len(table), -1)
    index[place] = np.arange(len(tall))
    here, height = place[able], tall[able]
    a, b = here.copy(), here.copy()
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            go = a - (1 << k)
            fits = (go >= 0) & (levels[k][np.maximum(go, 0)] >= height)
            a = np.where(fits, go, a)
            fits = (b + 1 + (1 << k) <= len(table)) & (levels[k][np.minimum(b + 1, len(table) - 1)] >= height)
            b = np.where(fits, b + (1 << k), b)
    size = height * (right[index[b]] - left[index[a]] + 1)
    found = np.flatnonzero(size == size.max())
    r1, k1 = r[able[found]] - height[found] + 1, left[index[a[found]]]
    k = np.lexsort((right[index[b[found]]], r[able[found]], k1, r1))[0]
    one = found[k]
    return int(size[one]), int(r1[k]), int(k1[k]), int(r[able[one]]), int(right[index[b[one]]])


#: Rows of a region whose windows are looked at together.
BAND = 64
#: A window's steps of the outer contour by its mask (bits 1, 2 in the upper row, 4, 8 in the lower): straight, diagonal, or two
#: diagonal ones (pixels at opposite corners).  And the ends of the step, as bits of the mask.
STRAIGHT, BENT, CROSSED = (3, 12, 5, 10), (7, 11, 13, 14), (6, 9)
STEP_ENDS = {**{m: m for m in STRAIGHT + CROSSED}, 7: 6, 14: 6, 11: 9, 13: 9}


def windows(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> Arrays:
    """(row, column, mask) of the 2x2 windows of a filled region that hold a step of its contour, band by band of its rows."""
    found = []
    for top in range(int(r[0]) - 1, int(r[-1]) + 1, BAND):
        own = slice(*np.searchsorted(r, [top, top + BAND + 1]))
        left, width = int(c0[own].min()) - 1, int(c1[own].max() - c0[own].min()) + 4
        edge = np.zeros((min(BAND, int(r[-1]) + 1 - top) + 1, width), np.int8)
        edge[r[own] - top, c0[own] - left] += 1  # no two runs begin, or end, at one place
        edge[r[own] - top, c1[own] + 1 - left] -= 1
        m = np.cumsum(edge, axis=1, dtype=np.int8)
        mask = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
        y, x = np.nonzero(_STEPS[mask])
        found.append((y + top, x + left, mask[y, x]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_STEPS = np.array([m in STEP_ENDS for m in range(16)])
_ENDS = np.array([STEP_ENDS.get(m, 0) for m in range(16)])
#: Half a step for each end, of two steps where they cross.
_END_WEIGHTS = np.array([1.0 if m in CROSSED else 0.5 for m in range(16)])


class Region:
    """An 8-connected region and what several of its figures need."""

    def __init__(self, r: np.ndarray, c0: np.ndarray, c1: np.ndarray):
        self.runs = (r, c0, c1)

    @cached_property
    def links(self) -> int:
        return len(touching(*self.runs, 1)[0])

    @cached_property
    def filled(self) -> Arrays:
        holes = 1 - len(self.runs[0]) + self.links
        return filled(*self.runs) if holes else self.runs

    @cached_property
    def corners(self) -> np.ndarray:
        return corner_hull(*self.runs)

    @cached_property
    def centres(self) -> np.ndarray:
        return centre_hull(*self.runs)

    @cached_property
    def pixels(self) -> Pixels:
        return Pixels(*self.runs)

    @cached_property
    def windows(self) -> Arrays:
        return windows(*self.filled)

    def filled_area(self) -> tuple:
        return (int((self.filled[2] - self.filled[1] + 1).sum()),)

    def link_count(self) -> tuple:
        return (self.links,)

    def contour_length(self) -> tuple:
        n = np.bincount(self.windows[2], minlength=16)
        straight, bent, crossed = (int(n[list(masks)].sum()) for masks in (STRAIGHT, BENT, CROSSED))
        return (straight + (bent + 2 * crossed) * math.sqrt(2),)

    def roundness(self) -> tuple:
        """distance, sigma, roundness, sides of the contour's steps, half a step at each end; None without steps."""
        r, c0, c1 = self.runs
        n = c1 - c0 + 1
        area = int(n.sum())
        # about the corner of the box, so that sums are exact
        row, col = r[0] + int(((r - r[0]) * n).sum()) / area, c0.min() + int(((c0 + c1 - 2 * c0.min()) * n).sum()) / 2 / area
        wr, wc, mask = self.windows
        if not len(mask):
            return (None,) * 4
        ends, weights = _ENDS[mask], _END_WEIGHTS[mask]
        at = [(np.flatnonzero(ends & (1 << (2 * i + j))), i, j) for i in (0, 1) for j in (0, 1)]
        y, x = (np.concatenate([o[here] + (i, j)[axis] for here, i, j in at]) for axis, o in enumerate((wr, wc)))
        d, w = np.hypot(y - row, x - col), np.concatenate([weights[here] for here, _, _ in at])
        whole = w.sum()
        distance = float((d * w).sum() / whole)
        sigma = math.sqrt(float(((d - distance) ** 2 * w).sum() / whole))
        sigma = 0.0 if sigma <= 1e-9 * distance else sigma
        return distance, sigma, 1 - sigma / distance if distance > 0 else None, 1.4111 * (distance / sigma) ** 0.4724 if sigma > 0 else None


#: Families of figures: their columns and how they are found.
FAMILIES: dict[str, tuple[str, Callable[[Region], tuple]]] = {
    "fill": ("filled_area long", Region.filled_area),
    "links": ("links long", Region.link_count),
    "contour": ("contlength double", Region.contour_length),
    "roundness": ("distance double, sigma double, roundness double, sides double", Region.roundness),
    "diameter": ("diameter double, diameter_r1 long, diameter_c1 long, diameter_r2 long, diameter_c2 long", lambda g: diameter(g.centres)),
    "hull": ("hull_area double", lambda g: (polygon_area(g.corners),)),
    "rect2": ("rect2_row double, rect2_col double, rect2_phi double, rect2_long double, rect2_short double", lambda g: rectangle2(g.corners)),
    "circle": ("circle_row double, circle_col double, circle_radius double", lambda g: enclosing_circle(g.corners)),
    "inner_circle": ("inner_row long, inner_col long, inner_radius double", lambda g: circle_figures(*inner_circle(g.pixels))),
    "inner_rect": ("inner_r1 long, inner_c1 long, inner_r2 long, inner_c2 long", lambda g: inner_rectangle(g.pixels)[1:]),
}


#: Runs of a shape at most whose figures are kept for regions of the same shape, and shapes that a process keeps.
RUNS_KEPT, SHAPES_KEPT = 16, 20_000


def figures(families: tuple[str, ...], r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple:
    region = Region(r, c0, c1)
    return sum((FAMILIES[f][1](region) for f in families), ())


@lru_cache(SHAPES_KEPT)
def _shape_figures(families: tuple[str, ...], runs: bytes) -> tuple:
    """Figures of the region whose box begins at (0, 0)."""
    return figures(families, *np.frombuffer(runs, np.int64).reshape(3, -1))


def measure(families: tuple[str, ...]) -> Callable[..., list[tuple]]:
    """Kernel: the columns of ``families``.  Small regions are found where they would lie at (0, 0), each shape once while it is kept, and moved."""
    names = [x.split()[0] for f in families for x in FAMILIES[f][0].split(", ")]
    moved = [(k, n.endswith(("_row", "_r1", "_r2"))) for k, n in enumerate(names) if n.endswith(("_row", "_r1", "_r2", "_col", "_c1", "_c2"))]

    def kernel(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[tuple]:
        if len(r) > RUNS_KEPT:
            return [figures(families, r, c0, c1)]
        top, left = int(r[0]), int(c0.min())
        out = list(_shape_figures(families, np.array([r - top, c0 - left, c1 - left]).tobytes()))
        for k, down in moved:
            if out[k] is not None:
                out[k] += top if down else left
        return [tuple(out)]

    return kernel


def geometry(regions: DataFrame, families: list[str]) -> DataFrame:
    """image_id, region_id and the columns of ``families`` of every region; others cost nothing."""
    return by_region(regions, ["r", "c0", "c1"], measure(tuple(families)), ", ".join(["image_id long, region_id long", *(FAMILIES[f][0] for f in families)]))
