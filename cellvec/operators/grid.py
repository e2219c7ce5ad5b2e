"""Hexagonal grids of cities, points to cells, counts and cell vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import AREA_CLASSES, KEYS, POINT_FEATURES, STREET_KEYS
from ..functions.geo import AREA_OF_R2, SQRT3, haversine_km, hex_radius, hex_ring, locate, project, unproject
from .order import places, quantiles

CELL = ["city", "row", "col"]


def grid_params(bounds: DataFrame, target_cells: int) -> DataFrame:
    """(city, lon0, lat0, minx, miny, maxx, maxy, land_m2) with the grid's r, w, minx0, miny0: one row per city."""
    x = bounds.withColumn("r", hex_radius(F.col("land_m2"), target_cells)).withColumn("w", F.lit(SQRT3) * F.col("r"))
    return x.withColumns({"minx0": F.col("minx") - F.col("w"), "miny0": F.col("miny") - F.col("r")})


def grid_cells(params: DataFrame) -> DataFrame:
    """All cells (city, row, col, cx, cy) of the grid around the bounds."""
    rows = F.floor((F.col("maxy") - F.col("miny") + 2 * F.col("r")) / (1.5 * F.col("r")))
    x = params.withColumn("row", F.explode(F.sequence(F.lit(0), rows.cast("int"))))
    x = x.withColumn("shift", F.when(F.col("row") % 2 == 1, F.col("w") / 2).otherwise(F.lit(0.0)))
    cols = F.floor((F.col("maxx") - F.col("minx") + 2 * F.col("w") - F.col("shift")) / F.col("w"))
    x = x.withColumn("col", F.explode(F.sequence(F.lit(0), cols.cast("int"))))
    return x.withColumns({"cx": F.col("minx0") + F.col("col") * F.col("w") + F.col("shift"), "cy": F.col("miny0") + F.col("row") * F.lit(1.5) * F.col("r")})


def meets_rectangle() -> Column:
    """Whether a cell's hexagon meets the bounds: no separating axis among the edges' normals."""
    dx, dy = F.abs(F.col("cx") - (F.col("minx") + F.col("maxx")) / 2), F.abs(F.col("cy") - (F.col("miny") + F.col("maxy")) / 2)
    hx, hy = (F.col("maxx") - F.col("minx")) / 2, (F.col("maxy") - F.col("miny")) / 2
    slanted = dx * 0.5 + dy * (SQRT3 / 2) <= F.col("w") / 2 + hx * 0.5 + hy * (SQRT3 / 2)
    return (dx <= F.col("w") / 2 + hx) & (dy <= F.col("r") + hy) & slanted


def to_cells(points: DataFrame, params: DataFrame) -> DataFrame:
    """Points with the row and col of their nearest cell; cities without a grid go."""
    grid = params.select("city", "lon0", "lat0", "r", "w", "minx0", "miny0")  # one row per city
    x = points.join(F.broadcast(grid), "city")
    px, py = project(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    x = x.withColumns({"x": px, "y": py}).withColumn("at", locate(F.col("x"), F.col("y")))
    return x.withColumns({"row": F.col("at.row"), "col": F.col("at.col")}).drop("at")


def feature_rules(spark: SparkSession) -> DataFrame:
    """(source, key, value, bits): the features of each tag value, as bits of a number; value * stands for any."""
    held: dict[tuple[str, str, str], int] = {}
    for i, f in enumerate(POINT_FEATURES):
        for v in (f.values or ("*",)) if f.tag and not f.rule else ():
            held[f.source, f.tag, v] = held.get((f.source, f.tag, v), 0) | 1 << i
    return spark.createDataFrame([(*k, bits) for k, bits in held.items()], "source string, key string, value string, bits long")


def feature_masks(located: DataFrame) -> DataFrame:
    """(city, row, col, mask, n): how many tags of a cell's points stand for the features whose bits the mask has. Tags become
    rows as they are; each meets the features' values by hash joins with tables of some 150 rows, and a point's own rules
    count with its first row. Rows of equal masks are added up before anything is told apart by feature."""
    bits = lambda features: F.lit(sum(1 << i for i in features)).cast("long")
    own = F.lit(0).cast("long")
    for source in dict.fromkeys(f.source for f in POINT_FEATURES):
        mine = [(i, f) for i, f in enumerate(POINT_FEATURES) if f.source == source]
        held = bits(i for i, f in mine if not f.rule and not f.tag)
        for i, f in mine:
            if f.rule:
                held = held.bitwiseOR(F.when(f.rule(), bits([i])).otherwise(bits([])))
        own = F.when(F.col("source") == source, held).otherwise(own)
    rules = feature_rules(located.sparkSession)
    some, every = rules.filter("value != '*'"), rules.filter("value = '*'").select("source", "key", F.col("bits").alias("any"))
    x = located.select(*CELL, "source", own.alias("own"), F.posexplode_outer("tags").alias("at", "key", "value"))
    x = x.join(F.broadcast(some), ["source", "key", "value"], "left").join(F.broadcast(every), ["source", "key"], "left")
    none = F.lit(0).cast("long")
    mask = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).otherwise(none).bitwiseOR(F.coalesce("bits", none)).bitwiseOR(F.when(F.col("value") != "", F.coalesce("any", none)).otherwise(none))
    return x.select(*CELL, mask.alias("mask")).groupBy(*CELL, "mask").agg(F.count("*").alias("n"))


def tagged(features: list[int]) -> Column:
    """The sum over rows of ``feature_masks`` of the features that each of a row's points counts for, among these."""
    held = F.bit_count(F.col("mask").bitwiseAND(F.lit(sum(1 << i for i in features)).cast("long")))
    return F.coalesce(F.sum(held * F.col("n")), F.lit(0).cast("long"))


def key_counts() -> list[Column]:
    return [tagged([i]).alias(k) for i, k in enumerate(KEYS)]


def cell_counts(located: DataFrame) -> DataFrame:
    """48 counts per cell in one pass; partial counts leave each task, so a cell that a third of all
    points fall in costs no more than others."""
    return feature_masks(located).groupBy(*CELL).agg(*key_counts())


def cell_activity(located: DataFrame) -> DataFrame:
    """cell_counts with the totals that the activity filter needs, as columns of the same aggregation:
    a filter over three columns, where one over 48 that later steps rename is slow to plan."""
    streets = [i for i, k in enumerate(KEYS) if k in STREET_KEYS]
    others = [i for i, k in enumerate(KEYS) if k not in [*STREET_KEYS, "buildings", "trees"]]
    some = {"street_points": streets, "other_points": others, "building_points": [KEYS.index("buildings")]}
    return feature_masks(located).groupBy(*CELL).agg(*key_counts(), *(tagged(chosen).alias(name) for name, chosen in some.items()))


def with_land(cells: DataFrame, areas: DataFrame) -> DataFrame:
    """Cells (.., area: the part inside the boundary) with class areas (city, row, col, cls, area):
    water and land area, fractions. Cells of too little area or land go."""
    wide = areas.groupBy(*CELL).agg(*(F.sum(F.when(F.col("cls") == c, F.col("area"))).alias(f"{c}_area") for c in AREA_CLASSES))
    x = cells.join(wide, CELL, "left").fillna(0.0, subset=[f"{c}_area" for c in AREA_CLASSES])
    hexagon = F.lit(AREA_OF_R2) * F.col("r") * F.col("r")
    x = x.filter(F.col("area") >= 0.15 * hexagon).withColumn("land", F.greatest(F.col("area") - F.least("water_area", "area"), F.lit(1.0)))
    x = x.filter(F.col("land") >= 0.12 * hexagon).withColumn("land_km2", F.col("land") / 1e6)
    share = lambda c: F.round(F.least(F.col(f"{c}_area") / (F.col("area") if c == "water" else F.col("land")), F.lit(1.0)), 4)
    return x.withColumns({f"{c}_frac": share(c) for c in AREA_CLASSES}).drop(*(f"{c}_area" for c in AREA_CLASSES))


ACTIVE = "street_points >= 3 or building_points >= 3 or other_points >= 2"


def is_active() -> Column:
    """Enough streets, buildings or other points."""
    total = lambda keys: sum((F.col(k) for k in keys), F.lit(0))
    streets = total(STREET_KEYS)
    return (streets >= 3) | (F.col("buildings") >= 3) | (total(KEYS) - streets - F.col("buildings") - F.col("trees") >= 2)


def densities() -> list[Column]:
    return [F.round(F.col(k) / F.col("land_km2"), 3).alias(k) for k in KEYS]


def with_centres(cells: DataFrame, params: DataFrame) -> DataFrame:
    """Cells (city, row, col) with the grid's parameters and cx, cy."""
    x = cells.join(F.broadcast(params.select("city", "lon0", "lat0", "r", "w", "minx0", "miny0")), "city")  # one row per city
    shift = F.when(F.pmod("row", F.lit(2)) == 1, F.col("w") / 2).otherwise(F.lit(0.0))
    return x.withColumns({"cx": F.col("minx0") + F.col("col") * F.col("w") + shift, "cy": F.col("miny0") + F.col("row") * F.lit(1.5) * F.col("r")})


def corners() -> Column:
    """The hexagon of a cell (with lon0, lat0, cx, cy, r) as six (lon, lat), to 5 digits."""
    def point(p):
        lon, lat = unproject(p["x"], p["y"], F.col("lon0"), F.col("lat0"))
        return F.struct(F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))

    return F.transform(hex_ring(F.col("cx"), F.col("cy"), F.col("r")), point)


def place_columns(center_lon: Column, center_lat: Column) -> dict[str, Column]:
    """cell_id, centre and distance of a cell (with lon0, lat0, cx, cy)."""
    lon, lat = unproject(F.col("cx"), F.col("cy"), F.col("lon0"), F.col("lat0"))
    return {"cell_id": F.concat_ws("_", "row", "col"), "lon": F.round(lon, 5), "lat": F.round(lat, 5), "dist_km": F.round(haversine_km(lon, lat, center_lon, center_lat), 2)}


def long_form(wide: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    return wide.unpivot(ids, keys, "feature", "value")


def sparse_features(values: DataFrame) -> DataFrame:
    """(city, feature, nonzero, cells, kept) from long rows (city, feature, value)."""
    x = values.groupBy("city", "feature").agg(F.count_if(F.col("value") != 0).alias("nonzero"), F.count("*").alias("cells"))
    return x.withColumn("kept", F.col("nonzero") >= F.greatest(F.lit(5.0), 0.02 * F.col("cells")))


def city_index(registry: DataFrame, cells: DataFrame, generated: str) -> DataFrame:
    """Registry rows with output, and their number of cells."""
    return registry.join(cells.groupBy("city").agg(F.count("*").alias("cells")), registry["slug"] == F.col("city")).drop("city").withColumn("generated", F.lit(generated))


def systematic_sample(points: DataFrame, most: int) -> DataFrame:
    """Every step-th point of a city, with the step: 1 where there are no more than ``most``. Points go by osm_id; those
    without one come first, by where they are and what they say, so points of TSV files are sampled too."""
    tags = F.to_json(F.array_sort(F.map_entries("tags")))
    x = places(points, ["city"], ["osm_id", "lat", "lon", "source", tags])
    step = F.greatest(F.lit(1), F.floor(F.col("total") / most))
    return x.withColumn("step", step).filter(F.col("before") % F.col("step") == 0).drop("before", "total")


def robust_extent(cells: DataFrame) -> DataFrame:
    """Bounds of the cells whose distance to the median centre is within 2.5 times its 95 % quantile."""
    mid = quantiles(cells.select("city", "lon", "lat").unpivot("city", ["lon", "lat"], "axis", "value"), ["city", "axis"], {"m": 0.5})
    mid = mid.groupBy("city").agg(*(F.max(F.when(F.col("axis") == c, F.col("m"))).alias(f"m{c}") for c in ("lon", "lat")))
    x = cells.join(mid, "city")  # mid, cut: one row per city
    x = x.withColumn("d", F.hypot((F.col("lon") - F.col("mlon")) * F.cos(F.radians("mlat")), F.col("lat") - F.col("mlat")))
    cut = quantiles(x, ["city"], {"q": 0.95}, "d").select("city", (F.col("q") * 2.5).alias("cut"))
    x = x.join(cut, "city").filter("d <= cut")
    return x.groupBy("city").agg(*(f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))))


def by_city(*order) -> Window:
    return Window.partitionBy("city").orderBy(*order)
