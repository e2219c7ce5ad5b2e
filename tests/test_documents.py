"""Documents and index on disk: valid JSON by city, cut to kept features; writing one city leaves the others."""

import glob
import json

from cellvec.jobs import cities, fixtures, queries
from cellvec.sources import documents
from cellvec.tables import keep

from .conftest import SF


def whole(path, city):
    """A city's files in the order of their names."""
    return json.loads("\n".join(open(f).read() for f in sorted(glob.glob(f"{path}/city={city}/part-*"))))


def test_run_to_disk(spark, tmp_path):
    areas, water = fixtures.lands(spark)
    bounds = keep(cities.city_bounds(areas, water), "bounds")
    cells = keep(queries.built(spark, SF), "cells")
    rows = [(i, f"City {i}", "X" if i else None, 100 + i, [1.0, 2.0], "centre") for i in range(5)]
    registry = spark.createDataFrame(rows, "slug int, name string, country string, osm_relation long, center array<double>, center_label string")
    path = f"file://{tmp_path}/run"
    index = {r.slug: r for r in cities.write_run(spark, cells, registry, areas, bounds, path, "2026-01-01", fixtures.TARGET_CELLS).collect()}
    assert set(index) == {0, 1, 2} and index[0].country == "" and index[1].generated == "2026-01-01"
    every = cells.toPandas()
    for city in range(3):
        doc, own = whole(f"{tmp_path}/run/cities", city), every[every.city == city].set_index("cell_id")
        keys = [f["key"] for f in doc["features"]]
        assert doc["name"] == f"City {city}" and doc["boundary"]["type"] == "MultiPolygon" and doc["groups"][0] == "Nightlife"
        ring = doc["boundary"]["coordinates"][0][0]
        assert ring[0] == ring[-1] and len(ring) == 7
        assert index[city].cells == len(doc["cells"]) == len(own) and 5 < len(keys) < 54
        least = max(5, 0.02 * len(own))
        assert all(((own[k] != 0).sum() >= least) == (k in keys) for k in [r.feature for r in cities.feature_table(spark).collect()])
        for c in doc["cells"]:
            assert c["v"] == [own.loc[c["id"], k] for k in keys] and len(c["p"]) == 6 and len(c["n"]) == sum(f["kind"] == "density" for f in doc["features"])
        places = [tuple(map(int, c["id"].split("_"))) for c in doc["cells"]]
        assert places == sorted(places)
    cities.write_run(spark, cells.filter("city = 1").limit(7), registry, areas, bounds, path, "2026-02-02", fixtures.TARGET_CELLS)
    assert len(whole(f"{tmp_path}/run/cities", 1)["cells"]) == 7 and len(whole(f"{tmp_path}/run/cities", 0)["cells"]) == index[0].cells
    listed = json.loads("".join(open(f).read() for f in glob.glob(f"{tmp_path}/run/index/part-*")))
    assert [(r["slug"], r["cells"], r["generated"]) for r in listed] == [(0, index[0].cells, "2026-01-01"), (1, 7, "2026-02-02"), (2, index[2].cells, "2026-01-01")]
    assert documents.read_documents(spark, f"{path}/cities").count() == sum(r["cells"] for r in listed)
