"""Geometry that is sequential by nature, in numpy: clipping, simplification, ring assembly, isolines.

Points are float arrays of shape (n, 2). The functions are used inside Arrow
batches; ``geoloom.operators.features`` has the DataFrame side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Box = tuple[float, float, float, float]


def grown(box: Box, fraction: float) -> Box:
    w, h = (box[2] - box[0]) * fraction, (box[3] - box[1]) * fraction
    return box[0] - w, box[1] - h, box[2] + w, box[3] + h


def clip_segment(a: np.ndarray, b: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a segment inside the box, by the parameter interval of each edge; None if there is none."""
    d = b - a
    lo, hi = 0.0, 1.0
    for p, q in ((-d[0], a[0] - box[0]), (d[0], box[2] - a[0]), (-d[1], a[1] - box[1]), (d[1], box[3] - a[1])):
        if p == 0:
            if q < 0:
                return None
        else:
            r = q / p
            if p < 0:
                lo = max(lo, r)
            else:
                hi = min(hi, r)
    if lo > hi:
        return None
    return (a if lo == 0 else a + lo * d), (b if hi == 1 else a + hi * d)


def clip_line(points: np.ndarray, box: Box) -> list[np.ndarray]:
    """Pieces of a line inside the box; consecutive parts that meet (to 1e-10) are one piece."""
    pieces: list[list[np.ndarray]] = []
    for a, b in zip(points[:-1], points[1:], strict=True):
        part = clip_segment(a, b, box)
        if part is None:
            continue
        if pieces and np.abs(pieces[-1][-1] - part[0]).max() < 1e-10:
            pieces[-1].append(part[1])
        else:
            pieces.append([part[0], part[1]])
    return [np.array(p) for p in pieces if len(p) >= 2]


def closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def clip_ring(ring: np.ndarray, box: Box) -> np.ndarray | None:
    """A ring cut by the box edge after edge (left, right, bottom, top), closed; None below three points."""
    points = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    for axis, bound, sign in ((0, box[0], 1.0), (0, box[2], -1.0), (1, box[1], 1.0), (1, box[3], -1.0)):
        if not len(points):
            return None
        depth = sign * (points[:, axis] - bound)
        after, depth_after = np.roll(points, -1, axis=0), np.roll(depth, -1)
        inside, inside_after = depth >= 0, depth_after >= 0
        out: list[np.ndarray] = []
        for i in range(len(points)):
            if inside[i]:
                out.append(points[i])
            if inside[i] != inside_after[i]:
                t = depth[i] / (depth[i] - depth_after[i])
                cut = points[i] + t * (after[i] - points[i])
                cut[axis] = bound
                out.append(cut)
        points = np.array(out).reshape(-1, 2)
    return closed(points) if len(points) >= 3 else None


def clip_parts(gtype: str, parts: list[list[np.ndarray]], box: Box, fraction: float = 0.0) -> list[list[np.ndarray]] | None:
    """A geometry inside the box grown by ``fraction``; of several line pieces the one with most points stays (the last on ties)."""
    box = grown(box, fraction)
    if gtype == "point":
        x, y = parts[0][0][0]
        return parts if box[0] <= x <= box[2] and box[1] <= y <= box[3] else None
    if gtype == "line":
        pieces = clip_line(parts[0][0], box)
        return [[max(reversed(pieces), key=len)]] if pieces else None
    out = []
    for rings in parts:
        outer = clip_ring(rings[0], box)
        if outer is not None:
            out.append([outer, *(h for h in (clip_ring(r, box) for r in rings[1:]) if h is not None)])
    return out or None


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points farther than the tolerance from the chord that replaces them (Ramer-Douglas-Peucker, with an explicit stack)."""
    n = len(points)
    if n < 3 or tolerance <= 0:
        return points
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, rel = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / length if length > 0 else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_parts(gtype: str, parts: list[list[np.ndarray]], tolerance: float, holes: bool = True) -> list[list[np.ndarray]]:
    """A simplified geometry; a ring or line that would get too short stays as it was."""
    least = {"line": 2}.get(gtype, 4)

    def one(points: np.ndarray) -> np.ndarray:
        short = simplify(points, tolerance)
        return short if len(short) >= least else points

    return parts if gtype == "point" else [[one(r) for r in (rings if holes else rings[:1])] for rings in parts]


def twice_area(ring: np.ndarray) -> float:
    x, y = ring[:-1, 0], ring[:-1, 1]
    u, v = ring[1:, 0], ring[1:, 1]
    return float((x * v - u * y).sum())


def wound(ring: np.ndarray, counter_clockwise: bool = True) -> np.ndarray:
    a = twice_area(ring)
    return ring[::-1] if (a < 0) == counter_clockwise and a != 0 else ring


def inside(point: np.ndarray, ring: np.ndarray) -> bool:
    """Whether the point lies strictly inside the ring (points on it do not)."""
    a, b = ring[:-1], ring[1:]
    cross = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (point[0] - a[:, 0])
    between = (np.minimum(a, b) <= point).all(1) & (point <= np.maximum(a, b)).all(1)
    if ((cross == 0) & between).any():
        return False
    spans = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    left = np.where(b[:, 1] > a[:, 1], cross > 0, cross < 0)
    return bool((spans & left).sum() % 2)


@dataclass
class Assembly:
    """Polygons of a relation (rings: outer first) and what went wrong."""

    polygons: list[list[np.ndarray]] = field(default_factory=list)
    open_rings: int = 0
    orphaned: int = 0
    degenerate: int = 0
    matched: int = 0
    error: str | None = None


def _keys(points: np.ndarray) -> list[tuple[int, int]]:
    scaled = points * 1e7
    return list(map(tuple, (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64).tolist()))


def _rings(lines: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Rings chained from segments by shared end points, in order of appearance; numbers of open and degenerate ones."""
    segments: list[tuple[np.ndarray, np.ndarray, tuple, tuple]] = []
    for line in lines:
        keys = _keys(line)
        segments += [(line[i], line[i + 1], keys[i], keys[i + 1]) for i in range(len(line) - 1) if keys[i] != keys[i + 1]]
    begins: dict[tuple, list[int]] = {}
    finishes: dict[tuple, list[int]] = {}
    for i, s in enumerate(segments):
        begins.setdefault(s[2], []).append(i)
        finishes.setdefault(s[3], []).append(i)
    used = [False] * len(segments)
    rings, open_, degenerate = [], 0, 0
    for seed in range(len(segments)):
        if used[seed]:
            continue
        used[seed] = True
        chain, tail = [segments[seed][0], segments[seed][1]], segments[seed][3]
        while not (len(chain) >= 4 and (chain[0] == chain[-1]).all()):
            ahead = next((i for i in begins.get(tail, ()) if not used[i]), None)
            back = None if ahead is not None else next((i for i in finishes.get(tail, ()) if not used[i]), None)
            if ahead is None and back is None:
                break
            i = ahead if ahead is not None else back
            used[i] = True
            chain.append(segments[i][1] if ahead is not None else segments[i][0])
            tail = segments[i][3] if ahead is not None else segments[i][2]
        ring = np.array(chain)
        if len(ring) < 4 or not (ring[0] == ring[-1]).all():
            open_ += 1
        elif twice_area(ring) == 0:
            degenerate += 1
        else:
            rings.append(ring)
    return rings, open_, degenerate


def assemble(outer: list[np.ndarray], inner: list[np.ndarray]) -> Assembly:
    """Polygons from member lines: outer rings counter-clockwise, holes clockwise in the smallest outer that holds them."""
    out = Assembly()
    outers, o1, d1 = _rings(outer)
    inners, o2, d2 = _rings(inner)
    out.open_rings, out.degenerate = o1 + o2, d1 + d2
    if not outers:
        out.error = "no outer rings"
        return out
    out.polygons = [[wound(r)] for r in outers]
    areas = [abs(twice_area(r)) for r in outers]
    for hole in inners:
        holders = [i for i in range(len(outers)) if inside(hole[0], outers[i])]
        if holders:
            out.polygons[min(holders, key=lambda i: areas[i])].append(wound(hole, False))
            out.matched += 1
        else:
            out.orphaned += 1
    return out


def levels(low: float, high: float, interval: int) -> list[int]:
    """Multiples of the interval within the range."""
    first, last = int(np.ceil(low / interval) * interval), int(np.floor(high / interval) * interval)
    return list(range(first, last + 1, interval))


def isolines(grid: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines of a height in grid coordinates (column, row), by marching squares with linear interpolation."""
    g = grid.astype(np.float64)
    up = g >= level
    code = up[:-1, :-1] * 8 + up[:-1, 1:] * 4 + up[1:, 1:] * 2 + up[1:, :-1] * 1
    rows, cols = np.nonzero((code > 0) & (code < 15))

    def crossing(r: int, c: int, edge: int) -> tuple[float, float]:
        (r0, c0), (r1, c1) = (((r, c), (r, c + 1)), ((r, c + 1), (r + 1, c + 1)), ((r + 1, c), (r + 1, c + 1)), ((r, c), (r + 1, c)))[edge]
        a, b = g[r0, c0], g[r1, c1]
        t = (level - a) / (b - a) if b != a else 0.5
        return c0 + t * (c1 - c0), r0 + t * (r1 - r0)

    # Edges 0 top, 1 right, 2 bottom, 3 left; saddles are split by the cell's mean.
    ends = {1: [(3, 2)], 2: [(2, 1)], 3: [(3, 1)], 4: [(0, 1)], 6: [(0, 2)], 7: [(3, 0)], 8: [(3, 0)], 9: [(0, 2)], 11: [(0, 1)], 12: [(3, 1)], 13: [(2, 1)], 14: [(3, 2)]}
    links: dict[tuple, list[tuple]] = {}
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
        k = int(code[r, c])
        if k in (5, 10):
            high = g[r : r + 2, c : c + 2].mean() >= level
            pairs = [(3, 0), (2, 1)] if (k == 5) == high else [(3, 2), (0, 1)]
        else:
            pairs = ends[k]
        for e, f in pairs:
            a, b = ((r + (x == 2), c, "h") if x in (0, 2) else (r, c + (x == 1), "v") for x in (e, f))
            links.setdefault(a, []).append((b, crossing(r, c, e), crossing(r, c, f)))
            links.setdefault(b, []).append((a, crossing(r, c, f), crossing(r, c, e)))
    done: set[frozenset] = set()
    lines = []
    for start in sorted(links, key=lambda k: (len(links[k]) != 1, k)):
        for first in links[start]:
            edge = frozenset((start, first[0]))
            if edge in done:
                continue
            points, at = [first[1], first[2]], first[0]
            done.add(edge)
            while nxt := next((n for n in links[at] if frozenset((at, n[0])) not in done), None):
                done.add(frozenset((at, nxt[0])))
                points.append(nxt[2])
                at = nxt[0]
            lines.append(np.array(points))
    return lines


def contours(tile: np.ndarray, south: int, west: int, box: Box, interval: int) -> list[tuple[int, int, np.ndarray]]:
    """(id, metres, lon/lat line) of a one-degree elevation tile inside a box; ids count down from -1."""
    extent = tile.shape[0]
    scale = extent - 1
    c0, c1 = max(0, int(np.floor((box[0] - west) * scale))), min(scale, int(np.ceil((box[2] - west) * scale)))
    r0, r1 = max(0, int(np.floor((south + 1 - box[3]) * scale))), min(scale, int(np.ceil((south + 1 - box[1]) * scale)))
    if c1 - c0 < 1 or r1 - r0 < 1:
        return []
    grid = tile[r0 : r1 + 1, c0 : c1 + 1].astype(np.float64)
    grid[(grid == -9999) | (grid == -32768)] = 0
    out = []
    for level in levels(float(grid.min()), float(grid.max()), interval):
        for line in isolines(grid, level):
            if len(line) >= 2:
                out.append((-1 - len(out), level, np.column_stack([west + (c0 + line[:, 0]) / scale, south + 1 - (r0 + line[:, 1]) / scale])))
    return out
