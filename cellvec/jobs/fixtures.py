"""Points, polygons and vectors that stand for cities, derived from the given tables.

The derivations are plain arithmetic, written once as SQL expressions and applied by Spark; the
checks' SQL applies the same expressions, as both need the same input, and nothing else of ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CENTERS = [(-74.0, 40.7), (-0.125, 51.5), (2.375, 48.875)]
TARGET_CELLS = 100


def pick(number: str, values: list[str | None]) -> str:
    """The value of a list at a place, as SQL."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


def where(source: str, inner: str) -> str:
    return f"CASE WHEN source = '{source}' THEN {inner} END"


#: Stages of (name, expression); each may use names of the stages before.
POINT_STAGES = [
    [("osm_id", "event_id"), ("user_id", "user_id"), ("city", "CAST(user_id % 3 AS INT)"), ("u", "(event_id * 7919 + user_id * 104729) % 10007"), ("v", "(event_id * 15485863 + user_id * 32452843) % 10009"), ("scale", "CASE WHEN user_id % 4 = 0 THEN 0.2e0 ELSE 1.0e0 END"), ("s", "(event_id * 31 + user_id) % 100"), ("t", "event_id * 17 + user_id * 13")],
    [("osm_id", "osm_id"), ("user_id", "user_id"), ("city", "city"), ("t", "t"), ("lon0", "CASE city WHEN 0 THEN -74.0e0 WHEN 1 THEN -0.125e0 ELSE 2.375e0 END"), ("lat0", "CASE city WHEN 0 THEN 40.7e0 WHEN 1 THEN 51.5e0 ELSE 48.875e0 END"), ("u", "u"), ("v", "v"), ("scale", "scale"), ("source", "CASE WHEN s < 35 THEN 'buildings' WHEN s < 60 THEN 'streets' WHEN s < 75 THEN 'amenity' WHEN s < 83 THEN 'shop' WHEN s < 90 THEN 'tlo' WHEN s < 96 THEN 'trees' ELSE 'transit' END")],
    [
        ("osm_id", "osm_id"), ("city", "city"), ("source", "source"), ("lon0", "lon0"), ("lat0", "lat0"),
        ("lon", "lon0 + (CAST(u AS DOUBLE) / 10007e0 - 0.5e0) * 0.2e0 * scale"), ("lat", "lat0 + (CAST(v AS DOUBLE) / 10009e0 - 0.5e0) * 0.15e0 * scale"),
        ("building", where("buildings", pick("t", ["yes", "house", "apartments", "detached", "office"]))),
        ("levels", where("buildings", pick("(osm_id + user_id * 2)", ["", "2", "6", "5;7", "12,5", "abc", "30"]))),
        ("height", where("buildings", pick("(osm_id + user_id)", ["", "20 m", "65 ft", "12'6\"", "25"]))),
        ("highway", "CASE WHEN source = 'streets' THEN " + pick("t", ["residential", "footway", "service", "primary", "cycleway", "secondary", "steps"]) + " WHEN source = 'transit' THEN " + pick("t", ["bus_stop", None, None, None]) + " END"),
        ("railway", where("transit", pick("t", [None, "station", "tram_stop", "subway_entrance"]))),
        ("amenity", where("amenity", pick("t", ["bar", "restaurant", "cafe", "school", "bank", "parking", "pharmacy", "library", "place_of_worship", "theatre", "fuel", "vending_machine"]))),
        ("shop", where("shop", pick("t", ["bakery", "clothes", "supermarket", "hairdresser", "books", "wine", "laundry", "yes"]))),
        ("tourism", where("tlo", pick("t", ["museum", "hotel", None, None, None, "artwork"]))),
        ("leisure", where("tlo", pick("t", [None, None, "park", "pitch", None, "garden"]))),
        ("office", where("tlo", pick("t", [None, None, None, None, "company", None]))),
    ],
]
TAGS = {"building": "building", "levels": "building:levels", "height": "height", "highway": "highway", "railway": "railway", "amenity": "amenity", "shop": "shop", "tourism": "tourism", "leisure": "leisure", "office": "office"}

#: One of each tag value that a feature asks for, and some that none does.
EVERY_TAG = {
    "amenity": ["bar", "pub", "biergarten", "nightclub", "casino", "stripclub", "music_venue", "events_venue", "restaurant", "cafe", "fast_food", "ice_cream", "theatre", "cinema", "arts_centre", "library", "place_of_worship", "school", "kindergarten", "childcare", "university", "college", "hospital", "doctors", "clinic", "dentist", "pharmacy", "bank", "atm", "police", "fire_station", "post_office", "community_centre", "social_facility", "marketplace", "veterinary", "bicycle_parking", "bicycle_rental", "parking", "fuel", "charging_station", "car_wash", "coworking_space", "bench", ""],
    "shop": ["alcohol", "wine", "bakery", "deli", "butcher", "cheese", "pastry", "confectionery", "coffee", "tea", "books", "supermarket", "convenience", "greengrocer", "general", "grocery", "clothes", "shoes", "jewelry", "boutique", "fashion_accessories", "bag", "watches", "hairdresser", "beauty", "massage", "tattoo", "cosmetics", "nail_salon", "laundry", "dry_cleaning", "hardware", "doityourself", "car_repair", "mobile_phone", "variety_store", "florist", ""],
    "tourism": ["museum", "gallery", "artwork", "attraction", "viewpoint", "hotel", "hostel", "guest_house", "motel", "apartment", "picnic_site"],
    "leisure": ["park", "nature_reserve", "garden", "playground", "dog_park", "pitch", "sports_centre", "fitness_centre", "swimming_pool", "golf_course", "track", "stadium", "marina"],
    "railway": ["station", "halt", "subway_entrance", "tram_stop", "rail"],
    "highway": ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "living_street", "pedestrian", "footway", "steps", "path", "cycleway", "service", "bus_stop"],
    "building": ["house", "detached", "semidetached_house", "terrace", "bungalow", "semi", "apartments", "residential", "dormitory", "yes", ""],
}
#: Source and tag of an event, by its number: every pair of a source with a tag of its own or of another's.
TAGGED = [("amenity", "amenity"), ("shop", "shop"), ("tlo", "tourism"), ("tlo", "leisure"), ("tlo", "office"), ("transit", "railway"), ("transit", "highway"), ("streets", "highway"), ("buildings", "building"), ("trees", "leisure"), ("shop", "amenity"), ("streets", "shop")]
TAGGED_POINT = [
    ("city", "CAST(user_id % 3 AS INT)"), ("source", "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(TAGGED)) + " END"), ("tag", "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(TAGGED)) + " END"),
    ("value", "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN " + (pick("(event_id // 12)", EVERY_TAG[t]) if t in EVERY_TAG else "'company'") for i, (_, t) in enumerate(TAGGED)) + " END"),
    ("levels", "CASE WHEN event_id % 12 = 8 THEN " + pick("(event_id // 12)", ["6", "5;7", "7,5", "3"]) + " END"), ("height", "CASE WHEN event_id % 12 = 8 THEN " + pick("(event_id // 12)", ["", "19 m", "66 ft", "20m", "65 ft"]) + " END"),
]

RECT_CLASS = "CASE WHEN p_type LIKE 'STANDARD%' THEN 'residential' WHEN p_type LIKE 'PROMO%' THEN 'commercial' WHEN p_type LIKE 'SMALL%' THEN 'industrial' WHEN p_type LIKE 'LARGE%' THEN 'green' WHEN p_type LIKE 'ECONOMY%' THEN 'water' ELSE 'beach' END"
RECT = [("city", "CAST(p_partkey % 3 AS INT)"), ("poly_id", "p_partkey"), ("cls", RECT_CLASS), ("mx", "CAST((p_partkey * 7919) % 20011 - 10005 AS DOUBLE)"), ("my", "CAST((p_partkey * 104729) % 16001 - 8000 AS DOUBLE)"), ("ex", "CAST(100 + p_size * 10 AS DOUBLE)"), ("ey", "CAST(80 + (p_partkey % 40) * 10 AS DOUBLE)")]
PIECE = [("city", "CAST(s_suppkey % 3 AS INT)"), ("piece_id", "s_suppkey"), ("mx", "CAST((s_suppkey * 7919) % 20011 - 10005 AS DOUBLE)"), ("my", "CAST((s_suppkey * 104729) % 16001 - 8000 AS DOUBLE)"), ("e", "CAST(1000 + (s_suppkey * 37) % 2000 AS DOUBLE)")]


def select(columns: list[tuple[str, str]], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {table}"


def points_sql() -> str:
    out = "events"
    for stage in POINT_STAGES:
        out = f"({select(stage, out)})"
    return out[1:-1]


def apply(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {n}" for n, e in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 points: city, source, osm_type, osm_id, lat, lon, tags."""
    x = table(spark, sf_dir, "events")
    for stage in POINT_STAGES:
        x = apply(x, stage)
    tags = F.map_filter(F.create_map(*[v for c, k in TAGS.items() for v in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    kind = F.when(F.col("source").isin("buildings", "streets"), "way").otherwise("node")
    return x.select("city", "source", kind.alias("osm_type"), "osm_id", "lat", "lon", tags.alias("tags"))


def tagged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with every tag value of the catalogue, some under sources that don't ask for them."""
    x = apply(table(spark, sf_dir, "events"), [(n, e.replace("//", "div")) for n, e in TAGGED_POINT])
    entry = lambda k, v: F.struct(k.alias("key"), F.col(v).alias("value"))
    entries = F.array(entry(F.col("tag"), "value"), entry(F.lit("building:levels"), "levels"), entry(F.lit("height"), "height"))
    return x.select("city", "source", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))


def bounds(spark: SparkSession) -> DataFrame:
    """Three cities' rectangles in metres around their centres."""
    x = spark.createDataFrame([(i, *c) for i, c in enumerate(CENTERS)], "city int, lon0 double, lat0 double")
    return x.selectExpr("city", "lon0", "lat0", *BOUNDS)


BOUNDS = ["-0.1e0 * 111320e0 * cos(radians(lat0)) AS minx", "-0.075e0 * 110540e0 AS miny", "0.1e0 * 111320e0 * cos(radians(lat0)) AS maxx", "0.075e0 * 110540e0 AS maxy", "4e0 * 0.1e0 * 111320e0 * cos(radians(lat0)) * 0.075e0 * 110540e0 AS land_m2"]
GRID_SQL = "SELECT *, minx - w AS minx0, miny - r AS miny0 FROM (SELECT *, sqrt(3e0) * r AS w FROM (SELECT *, least(1200e0, greatest(250e0, sqrt(land_m2 / (" + str(TARGET_CELLS) + " * 2.598e0)))) AS r FROM (SELECT *, " + ", ".join(BOUNDS) + " FROM (VALUES (0, -74.0e0, 40.7e0), (1, -0.125e0, 51.5e0), (2, 2.375e0, 48.875e0)) t(city, lon0, lat0))))"


def rectangle_rings(mx: str, my: str, ex: str, ey: str) -> F.Column:
    corner = lambda a, b: F.struct((F.col(mx) + a * F.col(ex)).alias("x"), (F.col(my) + b * F.col(ey)).alias("y"))
    return F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))


def land_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "part"), RECT).select("city", "poly_id", "cls", rectangle_rings("mx", "my", "ex", "ey").alias("rings"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows (city, cell_id, land_km2, dist_km, feature, idx, grp, value) from the embeddings."""
    x = vectors(spark, sf_dir).select("city", "cell_id", "land_km2", "dist_km", F.posexplode("v").alias("idx", "value"))
    return x.withColumns({"feature": F.concat(F.lit("f"), "idx"), "grp": F.concat(F.lit("g"), F.expr("idx div 8"))})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("city"), F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"), (0.5 + F.col("vec_id") % 7 * 0.1).alias("land_km2"), (F.col("vec_id") * 37 % 1000 / 50.0).alias("dist_km"))


VALUES_SQL = "SELECT city, cell_id, land_km2, dist_km, idx, 'f' || idx AS feature, 'g' || (idx // 8) AS grp, v[idx + 1] AS value FROM (SELECT label AS city, vec_id AS cell_id, 0.5e0 + (vec_id % 7) * 0.1e0 AS land_km2, ((vec_id * 37) % 1000) / 50e0 AS dist_km, CAST(embedding AS DOUBLE[]) AS v, unnest(range(64))::INT AS idx FROM embeddings)"


def lands(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Three cities' boundaries (city, lon0, lat0, parts): their rectangles without the north-eastern quarter; and their
    water (city, rings): a rectangle in the south-west."""
    x = bounds(spark)
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x1, y1, x2, y2, o = F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), F.lit(0.0)
    ring = F.array(p(x1, y1), p(x2, y1), p(x2, o), p(o, o), p(o, y2), p(x1, y2))
    wet = F.array(p(x1, y1), p(x1 / 2, y1), p(x1 / 2, y1 / 2), p(x1, y1 / 2))
    return x.select("city", "lon0", "lat0", F.array(F.array(ring)).alias("parts")), x.select("city", F.array(wet).alias("rings"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a city of its own: (city, mx, my, ex, ey), parts (its rectangle without the north-eastern quarter)
    and rings (its south-western quarter)."""
    x = apply(table(spark, sf_dir, "part"), RECT).drop("city").withColumnRenamed("poly_id", "city")
    p = lambda a, b: F.struct((F.col("mx") + a * F.col("ex")).alias("x"), (F.col("my") + b * F.col("ey")).alias("y"))
    shape = F.array(p(-1, -1), p(1, -1), p(1, 0), p(0, 0), p(0, 1), p(-1, 1))
    wet = F.array(p(-1, -1), p(0, -1), p(0, 0), p(-1, 0))
    return x.select("city", "mx", "my", "ex", "ey", F.array(F.array(shape)).alias("parts"), F.array(wet).alias("rings"))


DISTRICT_SQL = "SELECT poly_id AS city, mx, my, ex, ey FROM (" + select(RECT, "part") + ")"


def region(name: str, parts: list[tuple[float, float, float, float]]) -> str:
    """SQL for the area of ix1 .. iy2 inside rectangles, the first less the others (which lie in it, apart)."""
    one = lambda r: f"(greatest(0, least(ix2, {r[2]}) - greatest(ix1, {r[0]})) * greatest(0, least(iy2, {r[3]}) - greatest(iy1, {r[1]})))"
    return " - ".join(one(r) for r in parts) + f" AS {name}"
