"""Polygons on cells against one polygon at a time; unions; points in polygons; orders and quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellvec.jobs import cities
from cellvec.operators import grid, order, overlay, stats

RINGS = "array<array<struct<x:double,y:double>>>"


def shapes(rng, n):
    """Stars around their middle, some large, some with a hole, as rings."""
    out = []
    for k in range(n):
        n_points = rng.integers(4, 30)
        a = (np.arange(n_points) + rng.random(n_points) * 0.8) / n_points * 2 * np.pi
        r = rng.random(len(a)) * rng.choice([0.3, 3, 15]) + 0.05
        c = rng.normal(size=2) * 8
        outer = np.stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)], axis=1)
        out.append([outer, c + (outer - c) * 0.4] if k % 3 == 0 else [outer])
    return out


def plain(rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


@pytest.mark.parametrize("shape", ["square", "hexagon"])
def test_cut_to_cells(spark, monkeypatch, shape):
    """Also where large polygons are halved, in tasks and between them; bad polygons give nothing."""
    monkeypatch.setattr(overlay, "SMALL", 40)
    monkeypatch.setattr(overlay, "LARGE", 3000)
    polys = shapes(np.random.default_rng(3), 40)
    rows = [("c", k, plain(p)) for k, p in enumerate(polys)] + [("c", 100, None), ("c", 101, []), ("c", 102, [[(0.0, 0.0), (1.0, 1.0)]]), ("c", 103, [[(0.0, 0.0), (1.0, float("nan")), (2.0, 5.0)]]), ("other", 104, plain(polys[0]))]
    params = spark.createDataFrame([("c", 1.0, 1.0 if shape == "square" else 3**0.5, -0.3, 0.2)], "city string, r double, w double, minx0 double, miny0 double")
    got = overlay.clip_to_cells(spark.createDataFrame(rows, f"city string, id long, rings {RINGS}"), params, shape, ["id"])
    got = {(r.id, r.row, r.col): r.area for r in got.groupBy("id", "row", "col").agg(F.sum("area").alias("area")).collect()}
    assert {k[0] for k in got} <= set(range(40))
    for k, p in enumerate(polys):
        whole = abs(overlay.ring_area(p[0])) - sum(abs(overlay.ring_area(h)) for h in p[1:])
        assert sum(v for i, v in got.items() if i[0] == k) == pytest.approx(whole)
    for (k, row, col), v in list(got.items())[::11]:
        if shape == "square":
            x, y = -0.3 + col, 0.2 + row
            window = np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])
        else:
            window = overlay.hexagon(-0.3 + col * 3**0.5 + (3**0.5 / 2 if row % 2 else 0), 0.2 + 1.5 * row, 1.0)
        assert v == pytest.approx(overlay.clipped_area(polys[k], window), abs=1e-9)


def test_overlapping_polygons_are_united():
    square = lambda a, b: [np.array([(a, a), (b, a), (b, b), (a, b)], dtype=float)]
    assert overlay.area_where([[square(0, 10)], [square(0, 6), square(3, 9)]], lambda i: i[0] & ~i[1]) == pytest.approx(37)
    assert overlay.area_where([[square(0, 4), square(2, 6), square(2, 6)]], lambda i: i[0]) == pytest.approx(28)
    hole = [*square(0, 6), *square(2, 4)]
    assert overlay.area_where([[hole, square(3, 5)]], lambda i: i[0]) == pytest.approx(33)


def test_points_in_polygons(spark):
    """Areas of some polygons with holes, one of them over another; a city without an area; a point in no cell."""
    rng = np.random.default_rng(5)
    polys = shapes(rng, 6)
    at = rng.normal(size=(4000, 2)) * 12
    points = spark.createDataFrame([("c" if k % 50 else "none", k, float(x), float(y)) for k, (x, y) in enumerate(at)], "city string, id long, x double, y double").repartition(3)
    areas = overlay.measures(spark.createDataFrame([("c", [plain(p) for p in polys])], f"city string, parts array<{RINGS}>"))
    got = sorted(r.id for r in overlay.inside(points, areas).collect())
    held = [overlay.contains(p, at[:, 0], at[:, 1]) for p in polys]
    assert got == [k for k in range(4000) if k % 50 and any(h[k] for h in held)] and len(got) > 100
    pieces = spark.createDataFrame([("c", k, plain(p)) for k, p in enumerate(polys)], f"city string, piece_id long, rings {RINGS}")
    n = {r.piece_id: r.n for r in overlay.buildings_of(pieces, points.withColumn("step", F.lit(3)), 2.0).groupBy("piece_id").agg(F.sum("step").alias("n")).collect()}
    assert n == {k: 3 * c for k, h in enumerate(held) if (c := sum(bool(v) for i, v in enumerate(h) if i % 50))}


def test_places_and_quantiles(spark, monkeypatch):
    """Many equal values, null groups and values, groups of one; also where the first ranges miss the ranks."""
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=900).round(1), "zeros": np.where(rng.random(700) < 0.8, 0, rng.random(700)), None: rng.random(40), "one": np.array([3.5]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(6)
    got = order.places(df.filter("value is not null"), ["g"], ["value"]).collect()
    for g, x in data.items():
        mine = sorted((r.before, r.value, r.total) for r in got if r.g == g)
        assert mine == [(k, v, len(x)) for k, v in enumerate(sorted(x.tolist()))]
    wanted = {"lo": 0.005, "low": 0.02, "m": 0.5, "p": 0.95, "hi": 0.995}
    known = df.filter("g is not null")

    def same():
        for r in order.quantiles(known, ["g"], wanted).collect():
            assert [r[n] for n in wanted] == pytest.approx([float(np.quantile(data[r.g], q)) for q in wanted.values()]), r.g

    same()
    real, calls = order.within, []

    def narrow(x, ranges, group, wanted):  # the first ranges hold nothing
        calls.append(1)
        return real(x, ranges.withColumns({"_lo2": F.lit(1e9), "_hi2": F.lit(2e9)}) if len(calls) == 1 else ranges, group, wanted)

    monkeypatch.setattr(order, "within", narrow)
    same()
    assert len(calls) == 2


def test_ranks_and_samples(spark):
    values = spark.createDataFrame([("c", k, "f", float(v)) for k, v in enumerate([1, 0, 0, 0, 5, 2, 2])] + [("d", 0, "f", 1.0)], "city string, cell_id int, feature string, value double")
    got = {(r.city, r.cell_id): r["rank"] for r in stats.percent_rank(values).collect()}
    assert [got["c", k] for k in range(7)] == pytest.approx([3 / 6, 0, 0, 0, 1, 4 / 6, 4 / 6]) and got["d", 0] == 0
    rows = [("c", None, float(k % 25), float(k), "s", {"a": str(k)}) for k in range(50)] + [("c", 7, 0.0, 0.0, "s", {})] * 3
    points = spark.createDataFrame(rows, "city string, osm_id long, lat double, lon double, source string, tags map<string,string>").repartition(4)
    got = grid.systematic_sample(points, 13).collect()
    every = sorted(rows[:50], key=lambda r: (r[2], r[3])) + rows[50:]
    assert sorted((r.osm_id or 0, r.lat, r.lon) for r in got) == sorted((r[1] or 0, r[2], r[3]) for r in every[::4]) and {r.step for r in got} == {4}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def district(spark, parts=False):
    """One file-like partition of a boundary with its water."""
    at = [("c", plain([np.array([(0, 0), (9, 0), (9, 7), (0, 7)], dtype=float)]), plain([np.array([(1, 1), (3, 1), (3, 3)], dtype=float)]))]
    x = spark.createDataFrame(at, f"city string, land {RINGS}, sea {RINGS}").coalesce(1)
    sea = x.select("city", F.col("sea").alias("rings"))
    return (x.select("city", F.lit(0.0).alias("lon0"), F.lit(0.0).alias("lat0"), F.array("land").alias("parts")) if parts else x.select("city", F.col("land").alias("rings"))), sea


def test_land_is_dealt_out_and_measured_once(spark):
    """Polygons of one task are dealt to others before they are cut, and a cell's land isn't measured again to be filtered."""
    land, sea = district(spark)
    params = spark.createDataFrame([("c", 2.0, 2.0, 0.0, 0.0)], "city string, r double, w double, minx0 double, miny0 double")
    x = overlay.cell_land(land, sea, params, "square")
    assert plan(x).count("REPARTITION_BY_COL") == 2 and plan(x).count("ArrowEvalPython") == 1
    assert sum(r.area for r in x.collect()) == pytest.approx(61)


def test_buildings_are_summed_by_blocks(spark, monkeypatch):
    """Many pieces over many buildings: sums of squares and blocks, no row a pair, and no growing table broadcast."""
    monkeypatch.setattr(overlay, "POINT_BLOCK", 64)
    monkeypatch.setattr(overlay, "PIECE_BLOCK", 8)
    monkeypatch.setattr(overlay, "TESTS", 512)
    rng = np.random.default_rng(8)
    polys = shapes(rng, 40)
    at = rng.normal(size=(3000, 2)) * 6
    points = spark.createDataFrame([("c", float(x), float(y), k % 3) for k, (x, y) in enumerate(at)], "city string, x double, y double, step long")
    pieces = spark.createDataFrame([("c", k, plain(p)) for k, p in enumerate(polys)], f"city string, piece_id long, rings {RINGS}")
    x = overlay.buildings_of(pieces, points, 2.0)
    n = {r.piece_id: r.n for r in x.groupBy("piece_id").agg(F.sum("step").alias("n")).collect() if r.n}
    want = {k: int((overlay.contains(p, at[:, 0], at[:, 1]) * (np.arange(3000) % 3)).sum()) for k, p in enumerate(polys)}
    assert n == {k: v for k, v in want.items() if v}
    assert x.count() < sum(overlay.contains(p, at[:, 0], at[:, 1]).sum() for p in polys) / 2
    assert plan(x).count("SortMergeJoin") >= 2


def test_many_places_are_swept_together(monkeypatch):
    """Overlapping rectangles, with and without a cut between batches, against squares of 1 counted one by one; stars of
    themselves."""
    rng = np.random.default_rng(4)
    boxes = [[[tuple(sorted(rng.choice(12, 2, replace=False))) + tuple(sorted(rng.choice(12, 2, replace=False))) for _ in range(rng.integers(0, 4))] for _ in range(2)] for _ in range(60)]
    square = lambda x1, x2, y1, y2: [np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], dtype=float)]
    layers = []
    for k in range(2):
        parts = [overlay.edges_of([square(*b) for b in place[k]]) for place in boxes]
        more = np.cumsum([0, *(len(place[k]) for place in boxes)])
        layers.append((np.concatenate([p[0] for p in parts]), np.repeat(np.arange(60), [len(p[0]) for p in parts]), np.concatenate([p[2] + m for p, m in zip(parts, more, strict=False)])))
    want = []
    for place in boxes:
        a, b = np.zeros((2, 12, 12), bool)
        for cover, some in zip((a, b), place, strict=True):
            for x1, x2, y1, y2 in some:
                cover[x1:x2, y1:y2] = True
        want.append((a & ~b).sum())
    for pairs in (1 << 19, 50):
        monkeypatch.setattr(overlay, "PAIRS", pairs)
        assert overlay.areas_where(layers, lambda i: i[0] & ~i[1], 60) == pytest.approx(np.array(want))
    for p in shapes(rng, 12):
        assert overlay.area_where([[p, p]], lambda i: i[0]) == pytest.approx(abs(overlay.ring_area(p[0])) - sum(abs(overlay.ring_area(h)) for h in p[1:]))


def test_boundary_land_is_dealt_out(spark):
    """The land of a boundary is cut in more tasks than read it, and its parameters are joined before the cells only."""
    areas, sea = district(spark, True)
    x = cities.city_bounds(areas, sea)
    assert plan(x).count("REPARTITION_BY_COL") == 2 and plan(x).count("ArrowEvalPython") == 1
    assert x.first().land_m2 == pytest.approx(61)


def test_boundaries_are_measured_in_one_pass(spark):
    """A large polygon is cut to pieces, and a boundary measured, as its rows pass: no query of its own looks for large ones."""
    areas, sea = district(spark, True)
    group = "one pass"
    spark.sparkContext.setJobGroup(group, group)
    cities.city_bounds(areas, sea)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    rows = [(1, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 1.5)]]]), (2, None), (3, [[[(0.0, 0.0), (1.0, None), (2.0, 5.0)]]])]
    got = {r.city: r for r in overlay.measures(spark.createDataFrame(rows, f"city long, parts array<{RINGS}>").coalesce(1)).collect()}
    assert (got[1].area, got[1].minx, got[1].maxy) == (7.75, 0.0, 2.0) and got[1].cx == pytest.approx((16 - 0.25 * 5 / 3) / 7.75)
    assert got[2].area is None and got[2].minx is None and got[3].area is None and (got[3].maxx, got[3].maxy) == (2.0, 5.0)
