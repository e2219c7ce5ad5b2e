"""Polygons on cells: ring assembly, clipped areas, points in polygons. Rings are arrays of (x, y).

Polygons that cover many cells or have many vertices are halved until each piece is small, and pieces are dealt
to the tasks anew; then all rings of a batch are cut to their cells at once. What goes on are areas, or the parts
of rings inside each cell; no whole ring is copied to cells. Where a cell crosses the border of a city's land,
its pieces meet the land's by an equi-join on the cell. Polygons that overlap are united by counting how many cover a
place. Bad polygons (rings of fewer than three points, or coordinates that are no numbers) give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import keep

SQRT3 = 3**0.5


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a simple ring inside a convex, counter-clockwise window, exact in area."""
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if len(ring) < 3:
            return ring[:0]
        side = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
        after, later = np.roll(ring, -1, axis=0), np.roll(side, -1)
        cross = (side >= 0) != (later >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(cross, side / (side - later), 0.0)
        met = ring + t[:, None] * (after - ring)
        both = np.stack([ring, met], axis=1).reshape(-1, 2)
        ring = both[np.stack([side >= 0, cross], axis=1).reshape(-1)]
    return ring


def clipped_area(rings: list[np.ndarray], window: np.ndarray) -> float:
    """Area of a polygon (outer ring, then holes) inside a convex window."""
    parts = [abs(ring_area(c)) if len(c := clip_convex(r, window)) >= 3 else 0.0 for r in rings]
    return max(0.0, parts[0] - sum(parts[1:]))


def hexagon(cx: float, cy: float, r: float) -> np.ndarray:
    a = np.radians(60.0 * np.arange(6) - 30)
    return np.column_stack([cx + r * np.cos(a), cy + r * np.sin(a)])


def contains(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Even-odd rule over all rings, for many points in blocks."""
    out = np.zeros(len(x), dtype=bool)
    for ring in rings:
        (x1, y1), (x2, y2) = ring.T, np.roll(ring, -1, axis=0).T
        step = max(1, block // max(1, len(ring)))
        for i in range(0, len(x), step):
            p, q = x[i : i + step, None], y[i : i + step, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = ((y1 > q) != (y2 > q)) & (p < (x2 - x1) * (q - y1) / (y2 - y1) + x1)
            out[i : i + step] ^= (hit.sum(axis=1) % 2).astype(bool)
    return out


def stitch_rings(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of four points or more from ways that share ends, in either direction."""
    pool = {i: list(w) for i, w in enumerate(ways) if len(w) >= 2}
    ends: dict[tuple[float, float], set[int]] = {}
    for i, w in pool.items():
        for p in (w[0], w[-1]):
            ends.setdefault(p, set()).add(i)

    def take(i: int) -> list[tuple[float, float]]:
        w = pool.pop(i)
        for p in (w[0], w[-1]):
            ends[p].discard(i)
        return w

    rings = []
    while pool:
        ring = take(max(pool))
        while ring[0] != ring[-1] and ends.get(ring[-1]):
            w = take(max(ends[ring[-1]]))
            ring += w[1:] if w[0] == ring[-1] else w[::-1][1:]
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def polygons(elements: DataFrame) -> DataFrame:
    """(city, type, id, part, rings) in lon and lat: closed ways, and relations by outer ring."""
    ring = "array<array<struct<x: double, y: double>>>"

    def build(frames):
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                line = lambda g: [(p["lon"], p["lat"]) for p in (g if g is not None else [])]
                found = []
                if e.type == "way":
                    w = line(e.geometry)
                    found = [[w]] if len(w) >= 4 and w[0] == w[-1] else []
                elif e.type == "relation" and e.members is not None:
                    by = {k: stitch_rings([line(m["geometry"]) for m in e.members if m["type"] == "way" and (m["role"] or "outer") == k]) for k in ("outer", "inner")}
                    for outer in by["outer"]:
                        shape = [np.array(outer[:-1])]
                        holes = [h for h in by["inner"] if contains(shape, np.array([h[0][0]]), np.array([h[0][1]]))[0]]
                        found.append([outer, *holes])
                out += [(e.city, e.type, e.id, k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in enumerate(found)]
            yield pd.DataFrame(out, columns=["city", "type", "id", "part", "rings"])

    kind = elements.schema["city"].dataType.simpleString()
    return elements.select("city", "type", "id", "geometry", "members").mapInPandas(build, f"city {kind}, type string, id long, part int, rings {ring}")


#: A layer of polygons of each of many places: edges (x1, y1, x2, y2), and the place and polygon of each.
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def edges_of(polygons: list[list[np.ndarray]]) -> Edges:
    """Edges of the polygons of one place, 0."""
    rings = [(k, r) for k, p in enumerate(polygons) for r in p]
    ends = [np.hstack([r, np.roll(r, -1, axis=0)]) for _, r in rings]
    of = [np.full(len(r), k) for k, r in rings]
    if not ends:
        return np.zeros((0, 4)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.concatenate(of)
    return np.vstack(ends), np.zeros(len(of), np.int64), of


def column_edges(column: pa.Array, whole: bool = False) -> Edges:
    """Edges of an Arrow column with the polygons of a place in each row, or with its only polygon if ``whole``; none where it
    is null."""
    sizes, x = [], column
    for _ in range(2 if whole else 3):
        sizes.append(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        x = x.flatten()
    if whole:
        sizes.insert(0, np.ones(len(column), np.int64))
    px, py = (x.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    size = sizes[2]
    last = np.cumsum(size) - 1
    after = np.arange(1, len(px) + 1)
    after[last[size > 0]] = (last - size + 1)[size > 0]
    of = np.repeat(np.repeat(np.arange(len(sizes[1])), sizes[1]), size)
    return np.stack([px, py, px[after], py[after]], axis=1), np.repeat(np.arange(len(column)), sizes[0])[of], of


def area_where(layers: list[list[list[np.ndarray]]], wanted: Callable[[list[np.ndarray]], np.ndarray]) -> float:
    """``areas_where`` of one place, with the polygons of each layer as lists of rings."""
    return float(areas_where([edges_of(p) for p in layers], wanted, 1)[0])


#: Pairs of edges that are looked at together.
PAIRS = 1 << 19


def areas_where(layers: list[Edges], wanted: Callable[[list[np.ndarray]], np.ndarray], n: int) -> np.ndarray:
    """For each of n places, the area that is wanted by which of the layers cover it. A layer is polygons (rings by the
    even-odd rule), of which one at least must cover the place; so polygons of a layer that overlap are united.

    Many places are swept together: as many as have PAIRS pairs of edges."""
    e, place = np.concatenate([v[0] for v in layers]), np.concatenate([v[1] for v in layers])
    layer = np.repeat(np.arange(len(layers)), [len(v[0]) for v in layers])
    before = np.cumsum([0, *(v[2].max(initial=-1) + 1 for v in layers)])
    of = np.concatenate([v[2] for v in layers]) + before[layer]
    keep_ = np.flatnonzero(e[:, 0] != e[:, 2])  # no upright ones
    keep_ = keep_[np.argsort(place[keep_], kind="stable")]
    e, place, layer, of = e[keep_], place[keep_], layer[keep_], of[keep_]
    e = np.where((e[:, 0] < e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]])
    out = np.zeros(n)
    many = np.bincount(place, minlength=n)
    begin, work = np.cumsum(many) - many, np.cumsum(many * many)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS, side="right")))
        some = slice(begin[i], begin[j - 1] + many[j - 1])
        out[i:j] = sweep_strips(e[some], place[some] - i, of[some], layer[some], len(layers), wanted, many[i:j])
        i = j
    return out


def spans(size: np.ndarray) -> np.ndarray:
    """0, 1, .. below each size, one behind the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def sweep_strips(e: np.ndarray, place: np.ndarray, of: np.ndarray, layer: np.ndarray, layers: int, wanted: Callable, many: np.ndarray) -> np.ndarray:
    """Areas of ``many`` places with so many edges each, from left to right and by place. Between neighbouring x of vertices
    and crossings of a place no edges cross, so a strip's part is its width times its length along the middle. Up a strip,
    each edge begins or ends the cover of its polygon in turn."""
    x1, y1, x2, y2 = e.T
    slope = (y2 - y1) / (x2 - x1)
    base = y1 - slope * x1
    begin = np.cumsum(many) - many
    later = np.repeat(begin + many, many) - np.arange(len(e)) - 1  # edges of the place behind each
    a = np.repeat(np.arange(len(e)), later)
    b = a + 1 + spans(later)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[b] - base[a]) / (slope[a] - slope[b])
    hit = np.flatnonzero((cross > np.maximum(x1[a], x1[b])) & (cross < np.minimum(x2[a], x2[b])))
    xs, of_x = np.concatenate((x1, x2, cross[hit])), np.concatenate((place, place, place[a[hit]]))
    order = np.lexsort((xs, of_x))
    xs, of_x = xs[order], of_x[order]
    strip = np.flatnonzero((of_x[1:] == of_x[:-1]) & (xs[1:] > xs[:-1]))
    middle, width, own = (xs[strip + 1] + xs[strip]) / 2, xs[strip + 1] - xs[strip], of_x[strip]
    out = np.zeros(len(many))
    work = np.cumsum(many[own])
    i = 0
    while i < len(own):  # strips times edges
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS, side="right")))
        s = np.repeat(np.arange(i, j), many[own[i:j]])
        on = begin[own[s]] + spans(many[own[i:j]])
        held = np.flatnonzero((x1[on] < middle[s]) & (middle[s] < x2[on]))
        s, on = s[held], on[held]
        y = base[on] + slope[on] * middle[s]
        up = np.lexsort((y, s))
        s, on, y = s[up], on[up], y[up]
        by = np.lexsort((of[on], s))  # the edges of a polygon in a strip, from below
        new = np.concatenate(([True], (np.diff(of[on][by]) != 0) | (np.diff(s[by]) != 0))) if len(by) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        change = 1 - 2 * (turn % 2)
        low = np.searchsorted(s, s, side="left")  # the first edge of each one's strip
        inside = []
        for k in range(layers):
            run = np.concatenate(([0], np.cumsum(np.where(layer[on] == k, change, 0))))
            inside.append((run[1:] - run[low])[:-1] > 0)
        same = np.flatnonzero((s[1:] == s[:-1]) & wanted(inside))
        out += np.bincount(own[s[same]], width[s[same]] * (y[same + 1] - y[same]), len(many))
        i = j
    return out


# ---- many rings at once ----


class Rings:
    """Many rings: the points of each behind those of the one before, and the number of each ring's polygon."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, poly: np.ndarray, hole: np.ndarray):
        self.x, self.y, self.size, self.poly, self.hole = x, y, size, poly, hole

    def take(self, k: np.ndarray) -> Rings:
        begin = np.cumsum(self.size) - self.size
        size = self.size[k]
        at = np.arange(int(size.sum())) + np.repeat(begin[k] - (np.cumsum(size) - size), size)
        return Rings(self.x[at], self.y[at], size, self.poly[k], self.hole[k])

    def clip(self, px: np.ndarray, py: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> Rings:
        """The part of each ring to the left of its own line through (px, py) along (dx, dy); what is left of a ring may
        have no points."""
        ring = np.repeat(np.arange(len(self.size)), self.size)
        after = np.arange(1, len(ring) + 1)
        last = np.cumsum(self.size) - 1
        after[last[self.size > 0]] = (last - self.size + 1)[self.size > 0]
        side = dx[ring] * (self.y - py[ring]) - dy[ring] * (self.x - px[ring])
        inside = side >= 0
        cross = inside != inside[after] if len(ring) else inside
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(cross, side / (side - side[after]), 0.0) if len(ring) else side
        both = np.stack([inside, cross], axis=1).reshape(-1)
        x = np.stack([self.x, self.x + t * (self.x[after] - self.x)], axis=1).reshape(-1)[both] if len(ring) else self.x
        y = np.stack([self.y, self.y + t * (self.y[after] - self.y)], axis=1).reshape(-1)[both] if len(ring) else self.y
        return Rings(x, y, np.bincount(np.repeat(ring, 2)[both], minlength=len(self.size)), self.poly, self.hole)

    def areas(self) -> np.ndarray:
        """Area of each ring."""
        if not len(self.x):
            return np.zeros(len(self.size))
        ring = np.repeat(np.arange(len(self.size)), self.size)
        last = np.cumsum(self.size) - 1
        after = np.arange(1, len(ring) + 1)
        after[last[self.size > 0]] = (last - self.size + 1)[self.size > 0]
        begin = (last - self.size + 1)[ring]
        x, y = self.x - self.x[begin], self.y - self.y[begin]  # from its first point: small numbers
        x2, y2 = self.x[after] - self.x[begin], self.y[after] - self.y[begin]
        return np.abs(np.bincount(ring, x * y2 - x2 * y, len(self.size))) / 2

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """minx, miny, maxx, maxy of each ring, which must have points."""
        begin = np.cumsum(self.size) - self.size
        return np.minimum.reduceat(self.x, begin), np.minimum.reduceat(self.y, begin), np.maximum.reduceat(self.x, begin), np.maximum.reduceat(self.y, begin)

    @staticmethod
    def of(column: pa.Array) -> Rings:
        """Rings of an Arrow column of polygons; a polygon with a bad ring has none."""
        outer = column.offsets.to_numpy()
        rings = column.values.slice(outer[0], outer[-1] - outer[0])
        inner = rings.offsets.to_numpy()
        points = rings.values.slice(inner[0], inner[-1] - inner[0])
        size, many = np.diff(inner), np.where(np.array(column.is_valid()), np.diff(outer), 0)
        poly = np.repeat(np.arange(len(column)), many)
        hole = np.arange(len(poly)) > np.repeat(np.cumsum(many) - many, many)
        x, y = (np.nan_to_num(points.field(c).to_numpy(zero_copy_only=False).astype(float), nan=np.inf) for c in "xy")
        whole = np.bincount(np.repeat(np.arange(len(size)), size), np.isinf(x) | np.isinf(y), len(size)) == 0
        bad = np.bincount(poly, (size < 3) | ~whole, len(column)) > 0
        return Rings(x, y, size, poly, hole).take(np.flatnonzero(~bad[poly]))

    def column(self, n: int) -> pa.Array:
        """Rings of three points or more as an Arrow column of n polygons."""
        r = self.take(np.flatnonzero(self.size >= 3))
        points = pa.StructArray.from_arrays([pa.array(r.x), pa.array(r.y)], names=["x", "y"])
        ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.ListArray.from_arrays(ends(np.bincount(r.poly, minlength=n)), pa.ListArray.from_arrays(ends(r.size), points))


#: Cells times points of a piece, beyond which it is halved; and beyond which its halves are dealt to other tasks.
SMALL, LARGE = 512, 1 << 20
#: Points that are cut to cells at once.
AT_ONCE = 1 << 18
POINTS = "array<array<struct<x: double, y: double>>>"


def grid_of(batch: pa.RecordBatch, shape: str) -> dict[str, np.ndarray]:
    """Of each polygon's grid: corner x0, y0, width w, radius r, and what rows are apart."""
    g = {n: batch.column(c).to_numpy().astype(float) for n, c in (("w", "w"), ("r", "r"), ("x0", "minx0"), ("y0", "miny0"))}
    return g | {"high": g["w"] if shape == "square" else 1.5 * g["r"]}


def cells_around(rings: Rings, g: dict[str, np.ndarray], shape: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, first row, rows, first column, columns) of the cells around each outer ring. Hexagons reach beyond their
    centres by r up and by w across, with the shift of odd rows."""
    outer = rings.take(np.flatnonzero(~rings.hole & (rings.size > 0)))
    if not len(outer.size):
        return (np.zeros(0, np.int64),) * 5
    minx, miny, maxx, maxy = outer.bounds()
    p = outer.poly
    up, wide = (0.0, 0.0) if shape == "square" else (g["r"][p], g["w"][p])
    row, col = np.floor((miny - g["y0"][p] - up) / g["high"][p]), np.floor((minx - g["x0"][p] - wide) / g["w"][p])
    rows, cols = np.floor((maxy - g["y0"][p] + up) / g["high"][p]) - row + 1, np.floor((maxx - g["x0"][p] + wide / 2) / g["w"][p]) - col + 1
    return p, row.astype(np.int64), rows.astype(np.int64), col.astype(np.int64), cols.astype(np.int64)


def halve(rings: Rings, some: np.ndarray) -> tuple[Rings, np.ndarray]:
    """Each of ``some`` polygons cut in two across its longer side, and the polygon of each piece."""
    n = len(some)
    place = np.full(int(rings.poly.max(initial=-1)) + 1, -1)
    place[some] = np.arange(n)
    own = rings.take(np.flatnonzero(place[rings.poly] >= 0))
    own.poly = place[own.poly]
    minx, miny, maxx, maxy = own.bounds()
    outer = np.flatnonzero(~own.hole)
    at = own.poly[outer]
    box = np.zeros((4, n))
    box[:, at] = np.stack([minx, miny, maxx, maxy])[:, outer]
    across = box[2] - box[0] >= box[3] - box[1]
    mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    parts = []
    for k, sign in enumerate((1.0, -1.0)):  # left of the line up and below the line along, then the rest
        dx, dy = np.where(across, 0.0, -sign), np.where(across, sign, 0.0)
        cut = own.clip(mx[own.poly], my[own.poly], dx[own.poly], dy[own.poly])
        kept = cut.take(np.flatnonzero((cut.size >= 3) & (cut.areas() > 0)))
        kept.poly = kept.poly + k * n
        parts.append(kept)
    both = Rings(*(np.concatenate([getattr(q, a) for q in parts]) for a in ("x", "y", "size", "poly", "hole")))
    return both, np.concatenate([some, some])


def costs(rings: Rings, g: dict[str, np.ndarray], shape: str, n: int) -> np.ndarray:
    """Cells times points of each of n polygons; none for those no larger than a cell, which aren't halved."""
    p, _, rows, _, cols = cells_around(rings, g, shape)
    out = np.zeros(n)
    if len(p):
        points = np.bincount(rings.poly, rings.size, n)
        minx, miny, maxx, maxy = rings.take(np.flatnonzero(~rings.hole & (rings.size > 0))).bounds()
        out[p] = np.where((maxx - minx > g["w"][p]) | (maxy - miny > g["high"][p]), rows * cols * points[p], 0)
    return out


def cut_large(polys: DataFrame, shape: str) -> DataFrame:
    """Polygons with the grid's columns, those of a cost beyond LARGE cut to pieces below it, in one pass over the rows: a
    polygon's pieces number some root of its cost, and are dealt out by the caller before they meet their cells."""
    names = [c for c in polys.columns if c != "rings"]

    def cut(batches):
        for batch in batches:
            rings, of, g = Rings.of(batch.column("rings")), np.arange(batch.num_rows), grid_of(batch, shape)
            large = np.flatnonzero(costs(rings, g, shape, len(of)) > LARGE)
            if not len(large):
                yield batch.select([*names, "rings"])
                continue
            rest = np.setdiff1d(of, large)
            yield batch.select([*names, "rings"]).take(pa.array(rest))
            for k in large.tolist():  # one by one, as pieces of many at once could be much
                yield from halves(rings.take(np.flatnonzero(rings.poly == k)), k, batch)

    def halves(rings, k, batch):
        rings.poly = np.zeros_like(rings.poly)
        of = np.array([k])
        while len(of):
            cost = costs(rings, {n: v[of] for n, v in grid_of(batch, shape).items()}, shape, len(of))
            big, done = np.flatnonzero(cost > LARGE), np.flatnonzero(cost <= LARGE)
            done = np.intersect1d(done, rings.poly)
            if len(done):
                place = np.full(len(of), -1)
                place[done] = np.arange(len(done))
                own = rings.take(np.flatnonzero(place[rings.poly] >= 0))
                own.poly = place[own.poly]
                rows = batch.take(pa.array(of[done]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), own.column(len(done))], names=[*names, "rings"])
            if not len(big):
                return
            rings, before = halve(rings, big)
            of = of[before]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in polys.select(*names).schema) + f", rings {POINTS}"
    return polys.mapInArrow(cut, schema)


def polygon_errors(polys: DataFrame) -> DataFrame:
    """polys (.., rings) that give no rows, with the reason; what a run should report beside its result."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    bad = lambda p: ~F.coalesce(number(p["x"]) & number(p["y"]), F.lit(False))
    reason = F.when(F.coalesce(F.size("rings"), F.lit(0)) <= 0, "no ring").when(F.exists("rings", lambda r: F.coalesce(F.size(r), F.lit(0)) < 3), "ring of fewer than three points")
    return polys.withColumn("reason", reason.when(F.exists("rings", lambda r: F.exists(r, bad)), "coordinate that is no number")).filter("reason is not null")


def clip_to_cells(polys: DataFrame, params: DataFrame, shape: str = "hexagon", keep_columns: Sequence[str] = ("cls",)) -> DataFrame:
    """(city, row, col, *keep_columns, area, parts) for each cell that a polygon (city, *keep_columns, rings in metres)
    meets: its area there, and its rings cut to the cell. A polygon that was halved may have some rows for a cell.
    shape: hexagon cells, or squares of side w. params: one row per city, whose r and w may be kept too. Polygons are dealt out
    before they are cut: those of a small file would all be cut by its few readers."""
    kept = list(keep_columns)
    own = [c for c in kept if c not in ("r", "w")]
    x = polys.select("city", *own, F.col("rings").cast(POINTS).alias("rings")).join(params.select("city", "r", "w", "minx0", "miny0"), "city")
    x = cut_large(x, shape).repartition(F.xxhash64("city", *own, "rings"))

    def clip(batches):
        for batch in batches:
            g = grid_of(batch, shape)
            rings, of = Rings.of(batch.column("rings")), np.arange(batch.num_rows)
            while True:
                own = {k: v[of] for k, v in g.items()}
                cost = costs(rings, own, shape, len(of))
                big = np.flatnonzero(cost > SMALL)
                small = rings.take(np.flatnonzero(cost[rings.poly] <= SMALL)) if len(big) else rings
                yield from cut_cells(small, own, shape, batch, of, kept)
                if not len(big):
                    break
                rings, before = halve(rings, big)
                of = of[before]

    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    return x.mapInArrow(clip, f"city {kinds['city']}, row int, col int, " + "".join(f"{c} {kinds[c]}, " for c in kept) + f"area double, parts {POINTS}")


def cut_cells(rings: Rings, g: dict[str, np.ndarray], shape: str, batch: pa.RecordBatch, of: np.ndarray, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``clip_to_cells`` for small polygons, AT_ONCE points cut together."""
    p, row, rows, col, cols = cells_around(rings, g, shape)
    if not len(p):
        return
    points = np.bincount(rings.poly, rings.size, len(of))
    order = np.argsort(rings.poly, kind="stable")
    first = np.searchsorted(rings.poly[order], p)
    many = np.bincount(rings.poly, minlength=len(of))[p]
    work = np.cumsum(rows * cols * points[p])
    i = 0
    while i < len(p):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + AT_ONCE, side="right")))
        n = (rows * cols)[i:j]
        poly = np.repeat(np.arange(i, j), n)  # a row for each polygon and cell
        at = np.arange(len(poly)) - np.repeat(np.cumsum(n) - n, n)
        r, c = row[poly] + at // cols[poly], col[poly] + at % cols[poly]
        pair = np.repeat(np.arange(len(poly)), many[poly])  # a ring for each of these
        ring = order[np.arange(len(pair)) - np.repeat(np.cumsum(many[poly]) - many[poly], many[poly]) + np.repeat(first[poly], many[poly])]
        own = rings.take(ring)
        own.poly = pair
        q = p[poly]
        x, y = g["x0"][q] + c * g["w"][q], g["y0"][q] + r * g["high"][q]
        if shape == "square":
            corners = [(x, y), (x + g["w"][q], y), (x + g["w"][q], y + g["w"][q]), (x, y + g["w"][q])]
        else:
            x = x + np.where(r % 2 == 1, g["w"][q] / 2, 0.0)
            corners = [(x + g["r"][q] * np.cos(a), y + g["r"][q] * np.sin(a)) for a in np.radians(60.0 * np.arange(6) - 30)]
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            own = own.clip(ax[own.poly], ay[own.poly], (bx - ax)[own.poly], (by - ay)[own.poly])
            own = own.take(np.flatnonzero(own.size > 0))
        area = np.maximum(np.bincount(own.poly, own.areas() * np.where(own.hole, -1, 1), len(poly)), 0)
        met = np.flatnonzero(area > 0)
        place = np.full(len(poly), -1)
        place[met] = np.arange(len(met))
        own = own.take(np.flatnonzero(place[own.poly] >= 0))
        own.poly = place[own.poly]
        source = batch.take(pa.array(of[q[met]]))
        yield pa.RecordBatch.from_arrays([source.column("city"), pa.array(r[met].astype(np.int32)), pa.array(c[met].astype(np.int32)), *(source.column(k) for k in kept), pa.array(area[met]), own.column(len(met))], names=["city", "row", "col", *kept, "area", "parts"])
        i = j


def overlay(polys: DataFrame, params: DataFrame, shape: str = "hexagon") -> DataFrame:
    """(city, row, col, cls, area) of polygons (city, cls, rings in metres) on the grid; overlapping
    polygons of a class add up."""
    return clip_to_cells(polys, params, shape).groupBy("city", "row", "col", "cls").agg(F.sum("area").alias("area"))


def cell_land(boundaries: DataFrame, water: DataFrame, params: DataFrame, shape: str = "hexagon") -> DataFrame:
    """(city, row, col, area, whole, land, sea) of every cell that meets a boundary (city, rings) outside the
    water (city, rings): the area of its land, whether that is the whole cell, and the polygons of either, cut to the
    cell. Boundaries that overlap are united, and so is water. A cell's few pieces come together in one row."""
    part = lambda df, name: clip_to_cells(df.select("city", "rings", F.lit(name).alias("cls")), params, shape, ("cls", "r", "w"))
    both = part(boundaries, "land").union(part(water, "sea"))
    pieces = lambda name: F.collect_list(F.when(F.col("cls") == name, F.col("parts")))
    x = both.groupBy("city", "row", "col").agg(F.sum(F.when(F.col("cls") == "land", F.col("area"))).alias("area"), pieces("land").alias("land"), pieces("sea").alias("sea"), F.first("r").alias("r"), F.first("w").alias("w"))
    x = x.filter("area is not null")
    full = F.col("w") * F.col("w") if shape == "square" else F.lit(1.5) * F.col("r") * F.col("w")

    @F.arrow_udf(DoubleType())
    def dry(land: pa.Array, sea: pa.Array) -> pa.Array:
        return pa.array(areas_where([column_edges(land), column_edges(sea)], lambda i: i[0] & ~i[1], len(land)))

    dry = dry.asNondeterministic()  # so that the filter below doesn't compute it again
    single = (F.size("sea") == 0) & (F.size("land") == 1)
    x = x.withColumn("area", F.when(~single, dry(F.when(~single, F.col("land")), F.when(~single, F.col("sea")))).otherwise(F.col("area")))
    x = x.withColumn("whole", (F.size("sea") == 0) & (F.col("area") >= full * (1 - 1e-9)))
    return x.filter("area > 1e-6").select("city", "row", "col", "area", "whole", "land", "sea")


def overlay_land(polys: DataFrame, land: DataFrame, params: DataFrame, shape: str = "hexagon") -> DataFrame:
    """As ``overlay``, for the part of each cell that is land (from ``cell_land``)."""
    x = clip_to_cells(polys, params, shape).join(land.select("city", "row", "col", "whole", "land", "sea"), ["city", "row", "col"])

    @F.arrow_udf(DoubleType())
    def common(parts: pa.Array, land: pa.Array, sea: pa.Array) -> pa.Array:
        return pa.array(areas_where([column_edges(parts, True), column_edges(land), column_edges(sea)], lambda i: i[0] & i[1] & ~i[2], len(parts)))

    common = common.asNondeterministic()  # so that the filter below doesn't compute it again
    inner, border = x.filter("whole"), x.filter("not whole").withColumn("area", common("parts", "land", "sea"))
    out = inner.select("city", "row", "col", "cls", "area").union(border.select("city", "row", "col", "cls", "area").filter("area > 0"))
    return out.groupBy("city", "row", "col", "cls").agg(F.sum("area").alias("area"))


def measures(polys: DataFrame) -> DataFrame:
    """polys (.., parts: polygons, rings, points (x, y)) with area (holes less), centroid cx, cy and bounds minx .. maxy.
    Outer rings may run either way."""
    names = ["area", "cx", "cy", "minx", "miny", "maxx", "maxy"]
    kept = polys.columns

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts_measures(batch.column("parts"))], names=[*kept, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polys.schema)
    return polys.mapInArrow(measure, own + "".join(f", {n} double" for n in names))


def parts_measures(column: pa.Array) -> list[pa.Array]:
    """Columns of ``measures`` for an Arrow column of lists of polygons; null where a coordinate or a list is null."""
    many, x, gap = [], column, []
    for _ in range(3):
        gap.append(x.is_null().to_numpy(zero_copy_only=False))
        many.append(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        x = x.flatten()
    part_row = np.repeat(np.arange(len(column)), many[0])
    ring_row = np.repeat(part_row, many[1])
    row = np.repeat(ring_row, many[2])
    points = [x.field(c) for c in "xy"]
    missing = [p.is_null().to_numpy(zero_copy_only=False) for p in points]
    px, py = (p.to_numpy(zero_copy_only=False).astype(float) for p in points)
    n, rings = len(column), len(many[2])
    ring = np.repeat(np.arange(rings), many[2])
    last = np.cumsum(many[2]) - 1
    after = np.arange(1, len(px) + 1)
    after[last[many[2] > 0]] = (last - many[2] + 1)[many[2] > 0]
    c = px * py[after] - px[after] * py
    hole = spans(many[1]) > 0
    per_ring = [np.bincount(ring, v, rings) for v in (c / 2, c * (px + px[after]) / 6, c * (py + py[after]) / 6)]
    sign = np.sign(per_ring[0]) * np.where(hole, -1.0, 1.0)
    area, mx, my = (np.bincount(ring_row, v * sign, n) for v in per_ring)
    none = gap[0] | (np.bincount(row, missing[0] | missing[1], n) > 0) | (np.bincount(part_row, gap[1], n) > 0) | (np.bincount(ring_row, gap[2], n) > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = [pa.array(area, mask=none), *(pa.array(m / area, mask=none | (area == 0)) for m in (mx, my))]
    size = np.bincount(row, minlength=n)
    some = size > 0
    begin = (np.cumsum(size) - size)[some]
    broken = gap[0] | (np.bincount(part_row, gap[1], n) > 0) | (np.bincount(ring_row, gap[2], n) > 0)
    for least in (True, False):
        for v, lost in ((px, missing[0]), (py, missing[1])):
            held = np.full(n, np.nan)
            if len(begin):  # a coordinate that is no number is above all others; nulls don't count
                held[some] = np.fmin.reduceat(v, begin) if least else np.maximum.reduceat(np.where(lost, -np.inf, v), begin)
            out.append(pa.array(held, mask=broken | (np.bincount(row, ~lost, n) == 0)))
    return out


#: Cells across the longer side of an area in its cover.
COVER = 64


def cover(polys: DataFrame, params: DataFrame, keep_columns: Sequence[str] = ()) -> DataFrame:
    """(city, row, col, *keep_columns, whole, pieces) of the square cells (params: city, w, minx0, miny0) that polygons
    (city, *keep_columns, rings) meet: whether one covers the whole cell, and else the edges (x1, y1, x2, y2) of what
    covers some of it. Polygons of the same city and keep_columns are united."""
    cut = clip_to_cells(polys, params.withColumn("r", F.col("w")), "square", keep_columns)
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    edges = F.flatten(F.transform("parts", lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), edge)))
    x = cut.join(params.select("city", "w"), "city").withColumn("whole", F.col("area") >= F.col("w") * F.col("w") * (1 - 1e-12))
    x = x.groupBy("city", "row", "col", *keep_columns).agg(F.max("whole").alias("whole"), F.collect_list(F.when(~F.col("whole"), edges)).alias("pieces"))
    return x.withColumn("pieces", F.when(~F.col("whole"), F.col("pieces")))


def contained(points: DataFrame, covered: DataFrame, params: DataFrame) -> DataFrame:
    """Points (city, x, y, ..) with each row of ``covered`` (from ``cover``) that holds them. They meet by the cell; in whole
    cells nothing is tested, in others the even-odd rule over the few edges there. Points on a border belong to the
    part above or to the right of it."""
    at = params.select("city", F.col("w").alias("_w"), F.col("minx0").alias("_x0"), F.col("miny0").alias("_y0"))
    x = points.join(at, "city").withColumns({"_col": F.floor((F.col("x") - F.col("_x0")) / F.col("_w")).cast("int"), "_row": F.floor((F.col("y") - F.col("_y0")) / F.col("_w")).cast("int")})
    y = covered.withColumnsRenamed({"row": "_row", "col": "_col", "whole": "_whole", "pieces": "_pieces"})
    crossed = lambda e: ((e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))) & (F.col("x") < (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    hit = F.exists("_pieces", lambda p: F.size(F.filter(p, crossed)) % 2 == 1)
    return x.join(y, ["city", "_row", "_col"]).filter(F.col("_whole") | hit).drop("_w", "_x0", "_y0", "_row", "_col", "_whole", "_pieces")


def cover_params(bounds: DataFrame, cells: int = COVER) -> DataFrame:
    """(city, w, minx0, miny0) of a grid of ``cells`` squares across the longer side of each city's bounds."""
    w = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) / cells
    return bounds.select("city", w.alias("w"), F.col("minx").alias("minx0"), F.col("miny").alias("miny0")).filter("w > 0")


def inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Points (city, x, y, ..) inside their city's area (city, parts, and minx .. maxy as of ``measures``)."""
    params = cover_params(areas)
    covered = keep(cover(areas.select("city", F.explode("parts").alias("rings")), params), "cover")
    size = covered.agg(F.count("*") + F.coalesce(F.sum(F.size(F.flatten("pieces"))), F.lit(0))).first()[0]
    return contained(points, F.broadcast(covered) if size <= FEW else covered.hint("merge"), params)


#: Rows and edges of a cover that may go to every task.
FEW = 1 << 17
#: Points, and pieces, of a square that are tested together.
POINT_BLOCK, PIECE_BLOCK = 4096, 512
#: Points and edges that are compared at once.
TESTS = 1 << 18


def buildings_of(pieces: DataFrame, buildings: DataFrame, side: float) -> DataFrame:
    """(city, piece_id, step) with sums of the steps of the buildings (city, x, y, step) inside each piece (city, piece_id,
    rings), some rows a piece. Pieces may overlap, so buildings aren't joined with them: whole squares of a side, which is
    to be some fraction of a piece's, take the square's sum, and on a piece's border blocks of the square's buildings meet
    blocks of the pieces there. Neither table is broadcast, as both grow."""
    params = pieces.select("city").distinct().select("city", F.lit(float(side)).alias("w"), F.lit(0.0).alias("minx0"), F.lit(0.0).alias("miny0"))
    square = ["city", "row", "col"]
    covered = keep(cover(pieces, params, ["piece_id"]), "cover")
    at = {"col": F.floor(F.col("x") / float(side)).cast("int"), "row": F.floor(F.col("y") / float(side)).cast("int")}
    b = keep(buildings.join(params.select("city"), "city", "left_semi").withColumns(at).select(*square, "x", "y", "step"), "buildings")
    sums = b.groupBy(*square).agg(F.sum("step").alias("step"), F.count("*").alias("n"))
    whole = covered.filter("whole").select(*square, "piece_id").hint("merge").join(sums, square).select("city", "piece_id", "step")

    dealt = lambda df, n, size, *by: df.withColumn("block", F.pmod(F.xxhash64(*by), F.ceil(F.col(n) / size)))
    point = dealt(b.join(sums.select(*square, "n"), square), "n", POINT_BLOCK, "x", "y").groupBy(*square, "block").agg(F.collect_list(F.struct("x", "y", "step")).alias("points")).drop("block")
    border = covered.filter("not whole")
    many = border.groupBy(*square).agg(F.count("*").alias("n"))
    border = dealt(border.join(many, square), "n", PIECE_BLOCK, "piece_id").groupBy(*square, "block").agg(F.collect_list(F.struct("piece_id", "pieces")).alias("own")).drop("block")
    x = border.hint("merge").join(point, square).select("city", "own", "points")
    kind = {f.name: f.dataType.simpleString() for f in [*pieces.schema, *sums.schema]}

    def count(batches):
        for batch in batches:
            points, own = batch.column("points"), batch.column("own")
            for k in range(batch.num_rows):
                p, mine = points[k].values, own[k].values
                x, y = (p.field(c).to_numpy(zero_copy_only=False) for c in "xy")
                steps = p.field("step").to_numpy(zero_copy_only=False)
                total = steps_inside(mine.field("pieces"), x, y, steps)
                hit = pa.array(np.flatnonzero(total))
                yield pa.RecordBatch.from_arrays([batch.column("city").take(pa.array(np.full(len(hit), k))), mine.field("piece_id").take(hit), pa.array(total[hit]).cast(batch_step)], names=["city", "piece_id", "step"])

    batch_step = pa.float64() if kind["step"] == "double" else pa.int64()
    return whole.union(x.mapInArrow(count, f"city {kind['city']}, piece_id {kind['piece_id']}, step {kind['step']}"))


def steps_inside(pieces: pa.Array, x: np.ndarray, y: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For each row of ``pieces`` (the edges of each polygon that a row unites), the sum of the steps of the points inside
    by the even-odd rule."""
    per_row = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    polygons = pieces.flatten()
    size = pc.list_value_length(polygons).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = polygons.flatten()
    e = np.stack([edges.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
    polygon = np.repeat(np.arange(len(size)), size)
    crossing = np.flatnonzero(e[1] != e[3])  # level edges are never crossed
    (x1, y1, x2, y2), polygon = e[:, crossing, None], polygon[crossing]
    row = np.repeat(np.arange(len(per_row)), per_row)
    out = np.zeros(len(per_row), steps.dtype)
    block = max(1, TESTS // max(1, len(polygon)))
    first = np.searchsorted(polygon, np.arange(len(size)))
    some = np.flatnonzero(np.diff(np.append(first, len(polygon))))  # polygons with edges
    rows = np.unique(row[some], return_index=True)
    for i in range(0, len(x) if len(some) else 0, block):
        p, q = x[i : i + block], y[i : i + block]
        hit = ((y1 > q) != (y2 > q)) & (p < (x2 - x1) * (q - y1) / (y2 - y1) + x1)
        odd = np.bitwise_xor.reduceat(hit, first[some], axis=0)
        if len(rows[1]) < len(some):
            odd = np.bitwise_or.reduceat(odd, rows[1], axis=0)
        out[rows[0]] += odd @ steps[i : i + block]
    return out


def water_pieces(pieces: DataFrame, buildings: DataFrame, least_km2: float = 0.02, most_density: float = 15.0) -> DataFrame:
    """Pieces (city, piece_id, area_m2) that are water: large and with few buildings to the km².
    buildings: (city, piece_id, step) of those inside each piece; a sampled one stands for ``step``."""
    n = buildings.groupBy("city", "piece_id").agg(F.sum("step").alias("n"))
    x = pieces.join(n, ["city", "piece_id"], "left").withColumn("buildings", F.coalesce("n", F.lit(0)))
    km2 = F.col("area_m2") / 1e6
    return x.withColumn("is_water", (km2 >= least_km2) & (F.col("buildings") / km2 < most_density)).drop("n")
