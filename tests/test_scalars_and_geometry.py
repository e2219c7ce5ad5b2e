import numpy as np
import pytest
from pyspark.sql import functions as F

from cellvec.catalog import LAND_USE, POINT_FEATURES
from cellvec.functions.scalars import height_m, is_tall, land_use_class, levels
from cellvec.operators import overlay, stats
from cellvec.operators.kmeans import kmeans_array


def test_levels_and_heights(spark):
    cases = [("6", 6.0), ("6;7", 6.0), ("5,5", 5.5), ("1,000", 1.0), ("", None), ("abc", None), ("6d", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(levels(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [b for _, b in cases]
    cases = [("20 m", 20.0), ("20m", 20.0), ("65 ft", 19.812), ("12'6\"", 3.6576), ("20m;30m", None), ("15;20", 15.0), ("7,5", 7.5), ("", None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(height_m(F.col("t")).alias("v")).collect()
    assert [r.v if r.v is None else round(r.v, 6) for r in got] == [b for _, b in cases]


def test_tall_and_classes(spark):
    rows = [({"building:levels": "6"}, True), ({"height": "66 ft"}, True), ({"height": "65 ft"}, False), ({"building:levels": "abc", "height": "25"}, True), ({}, False)]
    assert [r.v for r in spark.createDataFrame([(a,) for a, _ in rows], "tags map<string,string>").select(is_tall().alias("v")).collect()] == [b for _, b in rows]
    rows = [({"landuse": "residential", "leisure": "park"}, "residential"), ({"natural": "bay"}, "water"), ({"aeroway": "aerodrome"}, "airport"), ({"landuse": ""}, None)]
    assert [r.v for r in spark.createDataFrame([(a,) for a, _ in rows], "tags map<string,string>").select(land_use_class(LAND_USE).alias("v")).collect()] == [b for _, b in rows]
    assert len(POINT_FEATURES) == 48


def test_clip_is_exact_and_tiles():
    hexagon = overlay.hexagon(0, 0, 2)
    assert overlay.ring_area(hexagon) == pytest.approx(1.5 * 3**0.5 * 4)
    half = [np.array([(0, -9.0), (9, -9), (9, 9), (0, 9)])]
    assert overlay.clipped_area(half, hexagon) == pytest.approx(0.75 * 3**0.5 * 4)
    ring, hole = np.array([(-3.0, -3), (3, -3), (3, 3), (-3, 3)]), np.array([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])
    assert overlay.clipped_area([ring, hole], hexagon) == pytest.approx(1.5 * 3**0.5 * 4 - 1)


def test_rings_and_points():
    assert overlay.stitch_rings([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1), (0, 0)]])[0].__len__() == 5
    assert overlay.stitch_rings([[(0, 0), (1, 0)], [(1, 0), (1, 1)]]) == []
    square = [np.array([(0.0, 0), (4, 0), (4, 4), (0, 4)]), np.array([(1.0, 1), (2, 1), (2, 2), (1, 2)])]
    assert overlay.contains(square, np.array([0.5, 1.5, 5]), np.array([0.5, 1.5, 1])).tolist() == [True, False, False]


def test_polygons_of_elements(spark):
    p = lambda *xy: [(float(b), float(a)) for a, b in xy]
    closed, opened = p((0, 0), (4, 0), (4, 4), (0, 0)), p((0, 0), (1, 0), (1, 1), (2, 2))
    a, b, hole = p((0, 0), (4, 0), (4, 4)), p((0, 0), (0, 4), (4, 4)), p((1, 2), (1, 3), (2, 3), (1, 2))
    rows = [("c", "way", 1, {}, closed, None), ("c", "way", 2, {}, opened, None), ("c", "node", 3, {}, closed[:1], None), ("c", "relation", 4, {}, None, [("way", "outer", a), ("way", "", b), ("way", "inner", hole)])]
    schema = "city string, type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>"
    got = {(r.id, r.part): len(r.rings) for r in overlay.polygons(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0): 1, (4, 0): 2}


def test_components_and_kmeans():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v, k = stats.eigen(np.cov(z.T), 0.86)
    assert w.sum() == pytest.approx(5) and np.allclose(v.T @ v, np.eye(5)) and 2 <= k <= 5
    assert all(col[np.argmax(abs(col))] > 0 for col in v.T)
    labels, centroids, inertia = kmeans_array(z, 3)
    assert inertia == pytest.approx(((z - centroids[labels]) ** 2).sum()) and set(labels) == {0, 1, 2}
    assert len(kmeans_array(z[:2], 5)[1]) == 2 and len(kmeans_array(z[:0], 5)[0]) == 0


def test_activity_is_added_up_by_masks(spark):
    """Counts and totals of cells against each feature's own predicate; equal points are one row before features are told apart."""
    from pyspark.sql import functions as F

    from cellvec.catalog import KEYS, POINT_FEATURES, STREET_KEYS
    from cellvec.jobs import fixtures
    from cellvec.operators import grid

    x = fixtures.tagged_points(spark, "/root/testdata/sf0.001").withColumns({"row": F.lit(0), "col": F.lit(0)}).coalesce(2).localCheckpoint()
    assert grid.feature_masks(x).agg(F.sum("n")).first()[0] > 2 * grid.feature_masks(x).count()
    got = {r.city: r for r in grid.cell_activity(x).collect()}
    want = x.groupBy("city").agg(*(F.count_if(f.matches()).alias(f.key) for f in POINT_FEATURES)).collect()
    for r in want:
        assert [got[r.city][k] for k in KEYS] == [r[k] for k in KEYS]
        assert got[r.city].street_points == sum(r[k] for k in STREET_KEYS) and got[r.city].building_points == r.buildings
        assert got[r.city].other_points == sum(r[k] for k in KEYS if k not in [*STREET_KEYS, "buildings", "trees"])
