"""Registered queries of the city operators, each with SQL of its own for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import AREA_CLASSES, KEYS, LAND_USE, POINT_FEATURES, STREET_KEYS
from ..functions.geo import haversine_km, project
from ..functions.scalars import height_m, is_tall, land_use_class, levels, tag
from ..operators import clusters, grid, kmeans, overlay, stats
from ..sources import documents
from ..sources.elements import LAND_USE_TAGS, land_use_elements, parse_boundary, parse_elements, parse_points, parse_registry, points_of, source_filters
from ..tables import keep, new_folder
from . import cities
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- points, cells, counts ----

LEVELS_SQL = "CASE WHEN regexp_full_match(trim(replace(split_part({0}, ';', 1), ',', '.')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(replace(split_part({0}, ';', 1), ',', '.')) AS DOUBLE) END"
HEIGHT_SQL = "CASE height WHEN '20 m' THEN 20e0 WHEN '65 ft' THEN 65e0 * 0.3048e0 WHEN '12''6\"' THEN 12e0 * 0.3048e0 WHEN '25' THEN 25e0 END"


def feature_sql(f) -> str:
    own = f"source = '{f.source}'"
    if f.rule:
        return f"{own} AND (coalesce({LEVELS_SQL.format('levels')} >= 6, false) OR coalesce({HEIGHT_SQL} >= 20, false))"
    if f.tag is None:
        return own
    return f"{own} AND {f.tag} IN ({', '.join(repr(v) for v in f.values)})" if f.values else f"{own} AND {f.tag} <> ''"


LOCATED_SQL = f"""
p AS ({X.points_sql()}), g AS ({X.GRID_SQL}),
q AS (SELECT p.*, g.r, g.w, g.minx0, g.miny0, (p.lon - g.lon0) * 111320e0 * cos(radians(g.lat0)) AS x, (p.lat - g.lat0) * 110540e0 AS y FROM p JOIN g USING (city)),
a AS (SELECT *, CAST(floor((y - miny0) / (1.5e0 * r)) AS INT) + (o // 2) AS "row" FROM q CROSS JOIN (VALUES (0), (1), (2), (3)) t(o)),
b AS (SELECT *, CASE WHEN abs("row") % 2 = 1 THEN w / 2 ELSE 0e0 END AS shift FROM a),
c AS (SELECT *, CAST(floor((x - minx0 - shift) / w) AS INT) + (o % 2) AS col FROM b),
d AS (SELECT *, (minx0 + col * w + shift - x) * (minx0 + col * w + shift - x) + (miny0 + "row" * 1.5e0 * r - y) * (miny0 + "row" * 1.5e0 * r - y) AS d FROM c),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY osm_id, source ORDER BY d, o) = 1)"""
COUNTS_SQL = f"{LOCATED_SQL},\nn AS (SELECT city, \"row\", col, {', '.join(f'count(*) FILTER (WHERE {feature_sql(f)}) AS {f.key}' for f in POINT_FEATURES)} FROM l GROUP BY ALL)"
ACTIVE_SQL = f"({' + '.join(STREET_KEYS)} >= 3 OR buildings >= 3 OR {' + '.join(k for k in KEYS if k not in STREET_KEYS + ['buildings', 'trees'])} >= 2)"
LAND_SQL = "(2.598076e0 * g.r * g.r / 1e6)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_counts(grid.to_cells(X.points(spark, sf_dir), grid.grid_params(X.bounds(spark), X.TARGET_CELLS)))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the land area of a whole hexagon."""
    r = grid.grid_params(X.bounds(spark), X.TARGET_CELLS).select("city", (2.598076 * F.col("r") * F.col("r") / 1e6).alias("land_km2"))
    return counts(spark, sf_dir).join(F.broadcast(r), "city")


@query(f"WITH {COUNTS_SQL} SELECT city, \"row\", col, {', '.join(f'round({k} / {LAND_SQL}, 3) AS {k}' for k in KEYS)} FROM n JOIN g USING (city)")
def cell_density(spark, sf_dir):
    return dense(spark, sf_dir).select("city", "row", "col", *grid.densities())


@query(f"WITH {COUNTS_SQL} SELECT * FROM n")
def cell_counts(spark, sf_dir):
    return counts(spark, sf_dir)


#: What each feature counts, written out: source, tag, values (none: any).
FEATURES_SQL = """
bars_pubs: amenity amenity bar pub biergarten
nightclubs: amenity amenity nightclub casino stripclub music_venue events_venue
liquor_stores: shop shop alcohol wine
restaurants: amenity amenity restaurant
cafes: amenity amenity cafe
fast_food: amenity amenity fast_food ice_cream
bakeries_delis: shop shop bakery deli butcher cheese pastry confectionery coffee tea
museums_galleries: tlo tourism museum gallery
theatres_cinemas: amenity amenity theatre cinema arts_centre
libraries: amenity amenity library
bookshops: shop shop books
places_of_worship: amenity amenity place_of_worship
public_art: tlo tourism artwork
attractions: tlo tourism attraction viewpoint
hotels: tlo tourism hotel hostel guest_house motel apartment
shops_total: shop shop
grocery: shop shop supermarket convenience greengrocer general grocery
fashion: shop shop clothes shoes jewelry boutique fashion_accessories bag watches
personal_care: shop shop hairdresser beauty massage tattoo cosmetics nail_salon
laundry_repair: shop shop laundry dry_cleaning hardware doityourself car_repair mobile_phone variety_store
schools: amenity amenity school kindergarten childcare
higher_ed: amenity amenity university college
healthcare: amenity amenity hospital doctors clinic dentist pharmacy
banks_atms: amenity amenity bank atm
public_safety: amenity amenity police fire_station post_office
community: amenity amenity community_centre social_facility marketplace veterinary
rail_stations: transit railway station halt
subway_entrances: transit railway subway_entrance
tram_stops: transit railway tram_stop
bus_stops: transit highway bus_stop
bike_infra: amenity amenity bicycle_parking bicycle_rental
car_parking: amenity amenity parking
fuel_charging: amenity amenity fuel charging_station car_wash
major_roads: streets highway motorway trunk primary secondary tertiary
local_streets: streets highway residential unclassified living_street
pedestrian_paths: streets highway pedestrian footway steps path
cycleways: streets highway cycleway
service_roads: streets highway service
buildings: buildings building
houses: buildings building house detached semidetached_house terrace bungalow semi
apartments: buildings building apartments residential dormitory
offices: tlo office
coworking: amenity amenity coworking_space
parks: tlo leisure park nature_reserve
gardens_playgrounds: tlo leisure garden playground dog_park
sports: tlo leisure pitch sports_centre fitness_centre swimming_pool golf_course track stadium
"""


def written_sql() -> str:
    out = ["source = 'trees' AS trees", "source = 'buildings' AND (levels IN ('6', '7,5') OR height IN ('66 ft', '20m')) AS tall_buildings"]
    for line in FEATURES_SQL.split("\n")[1:-1]:
        key, _, rest = line.partition(": ")
        source, tag_, *values = rest.split()
        out.append(f"source = '{source}' AND tag = '{tag_}' AND " + (f"value IN ({', '.join(map(repr, values))})" if values else "value <> ''") + f" AS {key}")
    return ", ".join(f"count(*) FILTER (WHERE {o.rpartition(' AS ')[0]}) AS {o.rpartition(' AS ')[2]}" for o in out)


@query(f"SELECT city, {written_sql()} FROM (SELECT city, source, tag, value, levels, height FROM ({X.select(X.TAGGED_POINT, 'events')})) GROUP BY city")
def every_feature(spark, sf_dir):
    """Each feature's count of a city, over points that carry every tag value of the catalogue."""
    x = X.tagged_points(spark, sf_dir).withColumns({"row": F.lit(0), "col": F.lit(0)})
    return grid.cell_counts(x).drop("row", "col")


@query(f"WITH {COUNTS_SQL} SELECT city, \"row\", col FROM n WHERE {ACTIVE_SQL}")
def active_cells(spark, sf_dir):
    return counts(spark, sf_dir).filter(grid.is_active()).select("city", "row", "col")


@query(f"WITH {COUNTS_SQL}, u AS (UNPIVOT n ON {', '.join(KEYS)} INTO NAME feature VALUE value) SELECT city, feature, count(*) FILTER (WHERE value <> 0) AS nonzero, count(*) AS cells, count(*) FILTER (WHERE value <> 0) >= greatest(5, 0.02e0 * count(*)) AS kept FROM u GROUP BY ALL")
def sparse_features(spark, sf_dir):
    return grid.sparse_features(grid.long_form(counts(spark, sf_dir), ["city", "row", "col"], KEYS))


@query(f"WITH {COUNTS_SQL} SELECT t.slug, t.name, count(*) AS cells, '2026-01-01' AS generated FROM n JOIN (VALUES (0, 'zero'), (1, 'one'), (7, 'seven')) t(slug, name) ON t.slug = n.city WHERE {ACTIVE_SQL} GROUP BY ALL")
def city_index(spark, sf_dir):
    registry = spark.createDataFrame([(0, "zero"), (1, "one"), (7, "seven")], "slug int, name string")
    return grid.city_index(registry, counts(spark, sf_dir).filter(grid.is_active()), "2026-01-01")


DISTRICT_GRID_SQL = f"SELECT *, minx - w AS minx0, miny - r AS miny0 FROM (SELECT *, sqrt(3e0) * r AS w FROM (SELECT *, least(1200e0, greatest(250e0, sqrt(land_m2 / (100 * 2.598e0)))) AS r FROM (SELECT city, mx - ex AS minx, my - ey AS miny, mx + ex AS maxx, my + ey AS maxy, 4 * ex * ey AS land_m2 FROM ({X.DISTRICT_SQL}))))"


@query(f"""WITH g AS ({DISTRICT_GRID_SQL}),
rr AS (SELECT *, unnest(range(CAST(floor((maxy - miny + 2 * r) / (1.5e0 * r)) AS INT) + 1))::INT AS "row" FROM g), rs AS (SELECT *, CASE WHEN "row" % 2 = 1 THEN w / 2 ELSE 0e0 END AS shift FROM rr),
rc AS (SELECT *, unnest(range(CAST(floor((maxx - minx + 2 * w - shift) / w) AS INT) + 1))::INT AS col FROM rs), k AS (SELECT *, abs(minx0 + col * w + shift - (minx + maxx) / 2) AS dx, abs(miny0 + "row" * 1.5e0 * r - (miny + maxy) / 2) AS dy, (maxx - minx) / 2 AS hx, (maxy - miny) / 2 AS hy FROM rc)
SELECT city, "row", col, round(minx0 + col * w + shift, 6) AS cx, round(miny0 + "row" * 1.5e0 * r, 6) AS cy FROM k
WHERE dx <= w / 2 + hx AND dy <= r + hy AND dx * 0.5e0 + dy * sqrt(3e0) / 2 <= w / 2 + hx * 0.5e0 + hy * sqrt(3e0) / 2 + 0""")
def hex_grid_rect(spark, sf_dir):
    """Cells that meet a rectangle, for every part's."""
    bounds = X.districts(spark, sf_dir).selectExpr("city", "mx - ex AS minx", "my - ey AS miny", "mx + ex AS maxx", "my + ey AS maxy", "4 * ex * ey AS land_m2")
    cells = grid.grid_cells(grid.grid_params(bounds, 100)).filter(grid.meets_rectangle())
    return cells.select("city", "row", "col", *r6("cx", "cy"))


CORNER_SQL = "radians(60e0 * i - 30e0)"


@query(f"""WITH {COUNTS_SQL}, k AS (SELECT n.city, "row", col, g.lon0, g.lat0, g.r, g.minx0 + col * g.w + CASE WHEN abs("row") % 2 = 1 THEN g.w / 2 ELSE 0e0 END AS cx, g.miny0 + "row" * 1.5e0 * g.r AS cy, unnest(range(6))::INT AS i FROM n JOIN g USING (city))
SELECT city, "row", col, i AS corner, round(lon0 + (cx + r * cos({CORNER_SQL})) / (111320e0 * cos(radians(lat0))), 5) AS lon, round(lat0 + (cy + r * sin({CORNER_SQL})) / 110540e0, 5) AS lat FROM k""")
def cell_corners(spark, sf_dir):
    cells = grid.with_centres(counts(spark, sf_dir).select("city", "row", "col"), grid.grid_params(X.bounds(spark), X.TARGET_CELLS))
    return cells.select("city", "row", "col", F.posexplode(grid.corners()).alias("corner", "p")).select("city", "row", "col", "corner", "p.lon", "p.lat")


@query(f"""WITH {COUNTS_SQL}, k AS (SELECT n.city, "row", col, g.lon0, g.lat0, g.r, g.minx0 + col * g.w + CASE WHEN abs("row") % 2 = 1 THEN g.w / 2 ELSE 0e0 END AS cx, g.miny0 + "row" * 1.5e0 * g.r AS cy FROM n JOIN g USING (city)),
centre AS (SELECT *, lon0 + cx / (111320e0 * cos(radians(lat0))) AS lon, lat0 + cy / 110540e0 AS lat, lon0 + 0.013e0 AS clon, lat0 - 0.007e0 AS clat FROM k)
SELECT city, "row" || '_' || col AS cell_id, round(lon, 5) AS lon, round(lat, 5) AS lat, round(2 * 6371e0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))), 2) AS dist_km, round(2.598076e0 * r * r / 1e6, 4) AS land_km2 FROM centre""")
def cell_places(spark, sf_dir):
    """Ids, centres, distances to a point off the middle, and land of cells, rounded as documents have them."""
    cells = grid.with_centres(counts(spark, sf_dir).select("city", "row", "col"), grid.grid_params(X.bounds(spark), X.TARGET_CELLS))
    at = grid.place_columns(F.col("lon0") + 0.013, F.col("lat0") - 0.007)
    return cells.withColumns(at).select("city", "cell_id", "lon", "lat", "dist_km", F.round(2.598076 * F.col("r") * F.col("r") / 1e6, 4).alias("land_km2"))


@query(f"""WITH p AS ({X.points_sql()}), k AS (SELECT city, osm_id, row_number() OVER (PARTITION BY city ORDER BY osm_id) - 1 AS place, greatest(1, count(*) OVER (PARTITION BY city) // 500) AS step FROM p)
SELECT city, osm_id, step FROM k WHERE place % step = 0""")
def systematic_sample(spark, sf_dir):
    return grid.systematic_sample(X.points(spark, sf_dir), 500).select("city", "osm_id", "step")


@query(f"""WITH p AS ({X.points_sql()}), k AS (SELECT city, osm_id, lat, lon, row_number() OVER (PARTITION BY city ORDER BY lat, lon, source, osm_id) - 1 AS place, greatest(1, count(*) OVER (PARTITION BY city) // 300) AS step FROM p WHERE source <> 'trees')
SELECT city, round(lat, 9) AS lat, round(lon, 9) AS lon, step FROM k WHERE place % step = 0""")
def sample_without_ids(spark, sf_dir):
    """Points as files hold them, without ids: sampled in the order of where they are."""
    x = X.points(spark, sf_dir).filter("source <> 'trees'").withColumn("osm_id", F.lit(None).cast("long"))
    return grid.systematic_sample(x, 300).select("city", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "step")


@query(f"WITH p AS ({X.points_sql()}), c(city, clon, clat) AS (VALUES (0, -74.0e0, 40.7e0), (1, -0.125e0, 51.5e0), (2, 2.375e0, 48.875e0)), h AS (SELECT osm_id, c.city, 2 * 6371e0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))) AS km FROM p CROSS JOIN c) SELECT osm_id, arg_min(city, (km, city)) AS nearest, round(min(km), 6) AS km FROM h GROUP BY osm_id")
def nearest_city_km(spark, sf_dir):
    options = [F.struct(haversine_km(F.col("lon"), F.col("lat"), F.lit(a), F.lit(b)).alias("km"), F.lit(i).alias("city")) for i, (a, b) in enumerate(X.CENTERS)]
    return X.points(spark, sf_dir).withColumn("near", F.least(*options)).select("osm_id", F.col("near.city").alias("nearest"), F.round("near.km", 6).alias("km"))


# ---- scalars, classes, sources ----


@query(f"WITH p AS ({X.points_sql()}) SELECT osm_id, {LEVELS_SQL.format('levels')} AS levels, round({HEIGHT_SQL}, 6) AS metres, {feature_sql(next(f for f in POINT_FEATURES if f.rule))} AS tall FROM p WHERE source = 'buildings'")
def parse_levels_height(spark, sf_dir):
    x = X.points(spark, sf_dir).filter("source = 'buildings'")
    return x.select("osm_id", levels(tag("building:levels")).alias("levels"), F.round(height_m(tag("height")), 6).alias("metres"), is_tall().alias("tall"))


LU_TAGS = [("landuse", ["residential", "retail", None, "military", "forest", None, ""]), ("leisure", ["park", None, "pitch", None, "playground"]), ("natural", [None, "water", "beach", "wood", None, "scree"]), ("aeroway", [None, None, None, "aerodrome"])]
LU_SQL = ", ".join(f'{X.pick("p_partkey", v)} AS "{k}"' for k, v in LU_TAGS)


@query(f"SELECT p_partkey, CASE {' '.join(f'WHEN ' + ' OR '.join(f'{chr(34)}{k}{chr(34)} IN ({chr(44).join(repr(v) for v in vs)})' for k, vs in rules.items()) + f' THEN {name!r}' for name, rules in LAND_USE.items())} END AS cls FROM (SELECT p_partkey, {LU_SQL} FROM part)")
def landuse_class(spark, sf_dir):
    x = X.table(spark, sf_dir, "part").selectExpr("p_partkey", *(f"{X.pick('p_partkey', v)} AS {k}" for k, v in LU_TAGS))
    tags = F.map_filter(F.create_map(*[v for k, _ in LU_TAGS for v in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    return x.select("p_partkey", tags.alias("tags")).select("p_partkey", land_use_class(LAND_USE).alias("cls"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as sub-boxes deliver them: every third one twice."""
    p = X.points(spark, sf_dir)
    g = F.array(F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")))
    members = F.lit(None).cast("array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>")
    e = p.select("city", F.col("osm_type").alias("type"), F.col("osm_id").alias("id"), F.when(F.col("source") == "trees", F.create_map(F.lit("natural"), F.lit("tree"))).otherwise(F.col("tags")).alias("tags"), g.alias("geometry"), members.alias("members"))
    return e.unionByName(e.filter("id % 3 = 0"))


@query(f"WITH p AS ({X.points_sql()}) SELECT city, source, count(*) AS n FROM p WHERE amenity IS DISTINCT FROM 'vending_machine' GROUP BY ALL")
def dedupe_elements(spark, sf_dir):
    return points_of(elements(spark, sf_dir)).groupBy("city", "source").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({X.points_sql()}) SELECT osm_id AS id, source FROM p WHERE source <> 'trees' AND amenity IS DISTINCT FROM 'vending_machine' UNION ALL SELECT osm_id, 'trees' FROM p WHERE source = 'trees'")
def source_rows(spark, sf_dir):
    x = elements(spark, sf_dir).dropDuplicates(["city", "type", "id"])
    hits = F.array_compact(F.array(*(F.when(p, F.lit(s)) for s, p in source_filters().items())))
    return x.select("id", F.explode(hits).alias("source"))


@query(f"WITH p AS ({X.points_sql()}) SELECT city, source, count(*) AS n FROM p WHERE amenity IS DISTINCT FROM 'vending_machine' AND source NOT IN ('trees', 'shop') GROUP BY ALL")
def skip_sources(spark, sf_dir):
    return points_of(elements(spark, sf_dir), skip=("trees", "shop")).groupBy("city", "source").agg(F.count("*").alias("n"))


def land_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element of every part, with land-use tags; its rectangle as a closed way, a relation of two ways (one
    reversed) with a hole of half its size, an open way, or a node."""
    x = X.apply(X.table(spark, sf_dir, "part"), [*X.RECT, *((k, X.pick("p_partkey", v)) for k, v in LU_TAGS)])
    tags = F.map_filter(F.create_map(*[v for k, _ in LU_TAGS for v in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    at = lambda a, b: F.struct((F.col("my") + b * F.col("ey")).alias("lat"), (F.col("mx") + a * F.col("ex")).alias("lon"))
    line = lambda *ps: F.array(*(at(*p) for p in ps))
    member = lambda role, g: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), g.alias("geometry"))
    members = F.array(member("outer", line((-1, -1), (1, -1), (1, 1))), member("", line((-1, -1), (-1, 1), (1, 1))), member("inner", line((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))))
    kind = F.col("poly_id") % 4
    closed, open_ = line((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)), line((-1, -1), (1, -1), (1, 1), (-1, 1))
    geometry = F.when(kind == 0, closed).when(kind == 2, open_).when(kind == 3, line((0, 0)))
    return x.select("city", F.when(kind == 1, "relation").when(kind == 3, "node").otherwise("way").alias("type"), F.col("poly_id").alias("id"), tags.alias("tags"), geometry.alias("geometry"), F.when(kind == 1, members).alias("members"))


ASKED_SQL = " OR ".join(f'"{k}" IN ({", ".join(repr(v) for v in vs)})' for k, vs in LAND_USE_TAGS.items())


@query(f"SELECT p_partkey AS id FROM (SELECT p_partkey, {LU_SQL} FROM part) WHERE {ASKED_SQL}")
def land_use_source(spark, sf_dir):
    return land_use_elements(land_elements(spark, sf_dir)).select("id")


@query(f"""SELECT poly_id AS id, CASE poly_id % 4 WHEN 0 THEN 'way' ELSE 'relation' END AS type, 0 AS part, poly_id % 4 AS holes, round(CASE poly_id % 4 WHEN 0 THEN 4 ELSE 3 END * ex * ey, 6) AS area FROM ({X.select(X.RECT, 'part')}) WHERE poly_id % 4 < 2""")
def multipolygons(spark, sf_dir):
    x = overlay.measures(overlay.polygons(land_elements(spark, sf_dir)).select("id", "type", "part", F.array("rings").alias("parts")))
    return x.select("id", "type", "part", (F.size(F.get("parts", F.lit(0))) - 1).cast("long").alias("holes"), *r6("area"))


@query(f"""SELECT poly_id AS id, CASE poly_id % 4 WHEN 1 THEN 'relation' WHEN 3 THEN 'node' ELSE 'way' END AS kind, round(mx, 6) AS lon, round(my, 6) AS lat FROM ({X.select(X.RECT, 'part')})""")
def representative_points(spark, sf_dir):
    """The middle of the bounds of ways, of relations' members and of nodes."""
    x = land_elements(spark, sf_dir).select("city", "type", "id", F.create_map(F.lit("building"), F.lit("yes"), F.lit("amenity"), F.lit("bar")).alias("tags"), "geometry", "members")
    return points_of(x).filter("source = 'amenity'").select(F.col("osm_id").alias("id"), F.col("osm_type").alias("kind"), *r6("lon", "lat"))


TSV_SQL = "osm_id % 11"


@query(f"WITH p AS ({X.points_sql()}) SELECT osm_id % 11 AS kind, city, lat, lon, coalesce(tourism, '') AS tourism, coalesce(leisure, '') AS leisure, CASE {TSV_SQL} WHEN 3 THEN '' ELSE coalesce(office, '') END AS office FROM p WHERE source = 'tlo' AND {TSV_SQL} > 2")
def points_tsv(spark, sf_dir):
    """Lines without latitude, with a word for it or with one field go; short lines and quoted fields stay."""
    x = X.points(spark, sf_dir).filter("source = 'tlo'").select("city", "osm_id", "lat", "lon", *(F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")).alias(k) for k in ("tourism", "leisure", "office")))
    kind = F.col("osm_id") % 11
    line = F.when(kind == 0, F.concat(F.lit("\t"), "lon")).when(kind == 1, F.concat_ws("\t", F.lit("north"), "lon", "tourism")).when(kind == 2, F.col("lat").cast("string"))
    line = line.when(kind == 3, F.concat_ws("\t", "lat", "lon", F.concat(F.lit('"'), "tourism", F.lit('"')), "leisure")).otherwise(F.concat_ws("\t", "lat", "lon", "tourism", "leisure", "office"))
    p = parse_points(x.select(F.struct("city", kind.alias("kind")).alias("city"), line.alias("value")), "tlo")
    return p.select("city.kind", "city.city", "lat", "lon", *(F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")).alias(k) for k in ("tourism", "leisure", "office")))


@query(f"WITH p AS ({X.points_sql()}) SELECT city, osm_id AS id, CASE WHEN source IN ('buildings', 'streets') THEN 'way' ELSE 'node' END AS type, shop, round(lat, 6) AS lat FROM p")
def elements_json(spark, sf_dir):
    """Answers of some ten elements, written as JSON and read back."""
    e = elements(spark, sf_dir).dropDuplicates(["city", "type", "id"]).withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")))
    bodies = e.groupBy("city", F.expr("id div 30").alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("type", "id", "tags", "geometry", "members")).alias("elements"))).alias("body"))
    return parse_elements(bodies).select("city", "id", "type", F.try_element_at("tags", F.lit("shop")).alias("shop"), F.round(F.get("geometry", F.lit(0))["lat"], 6).alias("lat"))


@query("SELECT lower(n_name) AS slug, n_name AS name, n_nationkey AS osm_relation, CAST(n_nationkey AS DOUBLE) AS lon, 0.5e0 - n_nationkey AS lat FROM nation WHERE n_nationkey % 5 <> 0")
def registry_json(spark, sf_dir):
    """Nations as cities, in one JSON list a region; a list of slugs keeps some."""
    n = X.table(spark, sf_dir, "nation")
    city = F.struct(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("osm_relation"), F.array(F.col("n_nationkey").cast("double"), 0.5 - F.col("n_nationkey")).alias("center"))
    raw = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(city)).alias("body")).select("body")
    wanted = [r.slug for r in n.filter("n_nationkey % 5 <> 0").select(F.lower("n_name").alias("slug")).collect()]  # 25 nations
    return parse_registry(raw, wanted).select("slug", "name", "osm_relation", F.get("center", F.lit(0)).alias("lon"), F.get("center", F.lit(1)).alias("lat"))


@query(f"SELECT piece_id, 1 + piece_id % 2 AS parts, round(CASE piece_id % 2 WHEN 0 THEN 3 ELSE 4 END * e * e, 6) AS area, round(mx - e, 6) AS minx FROM ({X.select(X.PIECE, 'supplier')})")
def boundary_geojson(spark, sf_dir):
    """Squares as GeoJSON: a Polygon with a hole of half its size, or a MultiPolygon of it and its south-western quarter's twin beyond (less its half)."""
    t = X.apply(X.table(spark, sf_dir, "supplier"), X.PIECE)
    ring = lambda x1, y1, x2, y2: F.array(*(F.array(F.col("mx") + a * F.col("e"), F.col("my") + b * F.col("e")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(-1, -1, 1, 1), ring(-0.5, -0.5, 0.5, 0.5)).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(-1, -1, 1, 1), ring(-0.5, -0.5, 0.5, 0.5)), F.array(ring(1, 1, 2, 2))).alias("coordinates")))
    polys = parse_boundary(t.select(F.struct("piece_id").alias("city"), F.when(F.col("piece_id") % 2 == 0, one).otherwise(two).alias("geojson")))
    parts = F.transform("polys", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y")))))
    x = overlay.measures(polys.select("city.piece_id", parts.alias("parts")))
    return x.select("piece_id", F.size("parts").cast("long").alias("parts"), *r6("area", "minx"))


# ---- polygons ----

SQUARE_SQL = f"""WITH t AS ({X.select(X.RECT, 'part')}), b AS (SELECT *, unnest(range(CAST(floor((my - ey + 20000) / 1000) AS INT), CAST(floor((my + ey + 20000) / 1000) AS INT) + 1))::INT AS "row" FROM t), c AS (SELECT *, unnest(range(CAST(floor((mx - ex + 20000) / 1000) AS INT), CAST(floor((mx + ex + 20000) / 1000) AS INT) + 1))::INT AS col FROM b),
o AS (SELECT *, greatest(0, least(mx + ex, -20000 + (col + 1) * 1000) - greatest(mx - ex, -20000 + col * 1000)) * greatest(0, least(my + ey, -20000 + ("row" + 1) * 1000) - greatest(my - ey, -20000 + "row" * 1000)) AS area FROM c), s AS (SELECT city, "row", col, cls, round(sum(area), 3) AS area FROM o WHERE area > 0 GROUP BY ALL)"""


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid_ = spark.createDataFrame([(i, 1000.0, 1000.0, -20000.0, -20000.0) for i in range(3)], "city int, r double, w double, minx0 double, miny0 double")
    return overlay.overlay(X.land_use(spark, sf_dir), grid_, "square").withColumn("area", F.round("area", 3))


@query(f'{SQUARE_SQL} SELECT city, "row", col, cls, round(area, 3) AS area FROM s')
def rect_overlay(spark, sf_dir):
    return squares(spark, sf_dir).withColumn("area", F.round("area", 3))


def whole_sql(cls: str) -> str:
    return f"CAST(coalesce(sum(area) FILTER (WHERE cls = '{cls}'), 0) AS BIGINT)"


#: Areas are whole square metres; shares are rounded half up to 4 digits in whole numbers.
FRAC_SQL = ", ".join(f"least((20000 * {c} + whole) // (2 * whole), 10000) / 10000e0 AS {c}_frac".replace("whole", "1000000" if c == "water" else "land") for c in AREA_CLASSES)


@query(f"""{SQUARE_SQL}, w AS (SELECT city, "row", col, {', '.join(f'{whole_sql(c)} AS {c}' for c in AREA_CLASSES)} FROM s GROUP BY ALL), l AS (SELECT *, greatest(1000000 - least(water, 1000000), 1) AS land FROM w)
SELECT city, "row", col, {FRAC_SQL} FROM l WHERE land >= 0.12 * 2.598076 * 384900.35""")
def cell_fractions(spark, sf_dir):
    areas = squares(spark, sf_dir).withColumn("area", F.round("area"))
    cells = areas.select("city", "row", "col").distinct().withColumns({"area": F.lit(1e6), "r": F.lit(384900.35**0.5)})
    return grid.with_land(cells, areas).select("city", "row", "col", *(f"{c}_frac" for c in AREA_CLASSES))


def square_params(x: DataFrame) -> DataFrame:
    return x.select("city", *(F.lit(v).alias(k) for k, v in {"r": 1000.0, "w": 1000.0, "minx0": -20000.0, "miny0": -20000.0}.items()))


CELL_SQL = """, a AS (SELECT *, unnest(range(CAST(floor((my - ey + 20000) / 1000) AS INT), CAST(floor((my + ey + 20000) / 1000) AS INT) + 1))::INT AS "row" FROM t), b AS (SELECT *, unnest(range(CAST(floor((mx - ex + 20000) / 1000) AS INT), CAST(floor((mx + ex + 20000) / 1000) AS INT) + 1))::INT AS col FROM a),
c AS (SELECT *, greatest(mx - ex, -20000 + col * 1000) AS ix1, least(mx + ex, -19000 + col * 1000) AS ix2, greatest(my - ey, -20000 + "row" * 1000) AS iy1, least(my + ey, -19000 + "row" * 1000) AS iy2 FROM b)"""


@query(f"""WITH t AS ({X.DISTRICT_SQL}){CELL_SQL}, d AS (SELECT *, {X.region('area', [('mx - ex', 'my - ey', 'mx + ex', 'my + ey'), ('mx', 'my', 'mx + ex', 'my + ey'), ('mx - ex', 'my - ey', 'mx', 'my')])} FROM c) SELECT city, "row", col, round(area, 3) AS area FROM d WHERE area > 0""")
def cell_land(spark, sf_dir):
    """Land of each cell: every part's boundary, which is no rectangle, without its water."""
    x = X.districts(spark, sf_dir)
    land = overlay.cell_land(cities.boundary_rings(x), x.select("city", "rings"), square_params(x), "square")
    return land.select("city", "row", "col", F.round("area", 3).alias("area"))


@query(f"SELECT city, round(3 * ex * ey, 6) AS area, round(mx - ex / 6, 6) AS cx, round(my - ey / 6, 6) AS cy, mx - ex AS minx, my + ey AS maxy, round(2 * ex * ey, 6) AS land_m2 FROM ({X.DISTRICT_SQL})")
def boundary_measures(spark, sf_dir):
    x = X.districts(spark, sf_dir).withColumns({"lon0": F.lit(0.0), "lat0": F.lit(0.0)})
    land = cities.city_bounds(x.select("city", "lon0", "lat0", "parts"), x.select("city", "rings")).select("city", "land_m2")
    return overlay.measures(x).join(land, "city").select("city", *r6("area", "cx", "cy"), "minx", "maxy", *r6("land_m2"))


REGION = [(-9000, -7000, 9000, 7000), (0, 0, 9000, 7000), (-9000, -7000, -4000, -3000)]


@query(f"""WITH t AS ({X.select(X.RECT, 'part')}){CELL_SQL}, d AS (SELECT *, {X.region('area', REGION)} FROM c) SELECT city, "row", col, cls, round(sum(area), 3) AS area FROM d WHERE area > 0 GROUP BY ALL""")
def land_overlay(spark, sf_dir):
    """Land use in the land of cells only: boundaries without a quarter, and without water."""
    p = lambda *xy: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in xy))
    three = spark.range(3).select(F.col("id").cast("int").alias("city"))
    land = three.select("city", F.array(p((-9000, -7000), (9000, -7000), (9000, 0), (0, 0), (0, 7000), (-9000, 7000))).alias("rings"))
    sea = three.select("city", F.array(p((-9000, -7000), (-4000, -7000), (-4000, -3000), (-9000, -3000))).alias("rings"))
    params = square_params(three)
    x = overlay.overlay_land(X.land_use(spark, sf_dir), overlay.cell_land(land, sea, params, "square"), params, "square")
    return x.withColumn("area", F.round("area", 3))


@query(f"WITH p AS ({X.points_sql()}), q AS (SELECT p.*, (lon - lon0) * 111320e0 * cos(radians(lat0)) AS x, (lat - lat0) * 110540e0 AS y FROM p), g AS ({X.GRID_SQL}) SELECT osm_id, q.city FROM q JOIN g USING (city) WHERE NOT (x > 0 AND y > 0) AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy")
def points_inside(spark, sf_dir):
    """Points inside their city's boundary, which lacks the north-eastern quarter of its bounds."""
    areas = overlay.measures(X.lands(spark)[0])
    x = X.points(spark, sf_dir).join(F.broadcast(areas.select("city", "lon0", "lat0")), "city")  # one row per city
    px, py = project(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return overlay.inside(x.select("osm_id", "city", px.alias("x"), py.alias("y")), areas).select("osm_id", "city")


@query(f"""WITH p AS ({X.points_sql()}), b AS (SELECT city, (lon - lon0) * 111320e0 * cos(radians(lat0)) AS x, (lat - lat0) * 110540e0 AS y FROM p WHERE source = 'buildings'), t AS ({X.select(X.PIECE, 'supplier')}),
n AS (SELECT t.piece_id, count(*) AS n FROM t JOIN b ON b.city = t.city AND b.x > mx - e AND b.x <= mx + e AND b.y > my - e AND b.y <= my + e GROUP BY 1)
SELECT t.city, t.piece_id, coalesce(n, 0) AS buildings, 4 * e * e / 1e6 >= 0.02 AND coalesce(n, 0) / (4 * e * e / 1e6) < 15 AS is_water FROM t LEFT JOIN n USING (piece_id)""")
def water_pieces(spark, sf_dir):
    t = X.apply(X.table(spark, sf_dir, "supplier"), X.PIECE)
    params = grid.grid_params(X.bounds(spark), X.TARGET_CELLS)
    b = grid.to_cells(X.points(spark, sf_dir).filter("source = 'buildings'"), params).select("city", "x", "y")
    pieces = t.select("city", "piece_id", X.rectangle_rings("mx", "my", "e", "e").alias("rings"))
    hit = overlay.buildings_of(pieces, b.withColumn("step", F.lit(1)), 500.0)
    return overlay.water_pieces(t.withColumn("area_m2", 4 * F.col("e") * F.col("e")), hit).select("city", "piece_id", "buildings", "is_water")


@query(f"WITH {LOCATED_SQL} SELECT city, \"row\", col, {', '.join(f'count(*) FILTER (WHERE {feature_sql(f)}) AS {f.key}' for f in POINT_FEATURES)} FROM l JOIN (SELECT city, minx, miny, maxx, maxy FROM g) USING (city) WHERE NOT (x > 0 AND y > 0) AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy GROUP BY ALL")
def counts_inside(spark, sf_dir):
    """Counts of cells on the border hold the points inside the boundary only."""
    points = grid.to_cells(X.points(spark, sf_dir), grid.grid_params(X.bounds(spark), X.TARGET_CELLS))
    return grid.cell_counts(overlay.inside(points, overlay.measures(X.lands(spark)[0])))


#: Land of two rectangles and water of two, all of which overlap; each in parts of a district's half sizes.
UNITED = {"a": (-1, -1, 1, 0.2), "b": (-1, -0.4, 0.4, 1), "v": (-1, -1, 0, 0), "w": (-0.5, -0.5, 0.5, 0.5)}


def united_sql() -> str:
    """(A + B - AB)(1 - V - W + VW), a product being what rectangles have in common."""
    terms = []
    for sign, land in ((1, "a"), (1, "b"), (-1, "ab")):
        for more, sea in ((1, ""), (-1, "v"), (-1, "w"), (1, "vw")):
            low = lambda k, m, e: ", ".join(f"{m} + {UNITED[n][k]} * {e}" for n in land + sea)
            side = lambda k, c, m, e: f"greatest(0, least({low(k + 2, m, e)}, {c}2) - greatest({low(k, m, e)}, {c}1))"
            terms.append(f"{'+' if sign * more > 0 else '-'} {side(0, 'ix', 'mx', 'ex')} * {side(1, 'iy', 'my', 'ey')}")
    return " ".join(terms)


@query("SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'no ring' WHEN 1 THEN 'no ring' WHEN 2 THEN 'ring of fewer than three points' WHEN 3 THEN 'ring of fewer than three points' ELSE 'coordinate that is no number' END AS reason FROM part WHERE p_partkey % 7 < 6")
def bad_polygons(spark, sf_dir):
    """Parts' rectangles, most of them broken in some way, with what is wrong."""
    x = X.land_use(spark, sf_dir).withColumn("ring", F.get("rings", F.lit(0)))
    point = lambda v: F.struct(F.lit(v).cast("double").alias("x"), F.lit(1.0).alias("y"))
    broken = [F.lit(None), F.filter("rings", lambda r: F.size(r) < 0), F.array("ring", F.slice("ring", 1, 2)), F.array(F.slice("ring", 1, 0)), F.array(F.concat("ring", F.array(point("NaN")))), F.array("ring", F.concat("ring", F.array(point(None))))]
    rings = F.col("rings")
    for k, b in enumerate(broken):
        rings = F.when(F.col("poly_id") % 7 == k, b).otherwise(rings)
    return overlay.polygon_errors(x.withColumn("rings", rings)).select(F.col("poly_id").alias("id"), "reason")


@query(f"""WITH t AS ({X.DISTRICT_SQL}){CELL_SQL}, d AS (SELECT *, {united_sql()} AS area FROM c) SELECT city, "row", col, round(area, 3) AS area FROM d WHERE area > 1e-6""")
def united_land(spark, sf_dir):
    """Land of each cell where boundaries overlap each other, and waters do."""
    x = X.districts(spark, sf_dir)
    at = lambda a, b: F.struct((F.col("mx") + a * F.col("ex")).alias("x"), (F.col("my") + b * F.col("ey")).alias("y"))
    ring = lambda x1, y1, x2, y2: F.array(at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2))
    some = lambda names: x.select("city", F.explode(F.array(*(F.array(ring(*map(F.lit, map(float, UNITED[n])))) for n in names))).alias("rings"))
    land = overlay.cell_land(some("ab"), some("vw"), square_params(x), "square")
    return land.select("city", "row", "col", F.round("area", 3).alias("area"))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = spark.createDataFrame([(i, *c) for i, c in enumerate(X.CENTERS)], "city int, clon double, clat double")
    areas, water = X.lands(spark)
    bounds = keep(cities.city_bounds(areas, water), "bounds")
    return cities.build_cells(X.points(spark, sf_dir), X.land_use(spark, sf_dir), areas, water, bounds, centers, X.TARGET_CELLS)


@query()
def city_cells(spark, sf_dir):
    """Points and polygons to cell vectors, inside boundaries that are no rectangles and without their water."""
    return built(spark, sf_dir)


@query()
def city_clusters(spark, sf_dir):
    """Points and polygons to named clusters, end to end."""
    return cities.cluster_cities(spark, keep(built(spark, sf_dir), "cells"), cities.feature_table(spark), cities.RunConfig())


# ---- statistics of vectors ----

Z_SQL = f"v AS ({X.VALUES_SQL}), z AS (SELECT *, (value - avg(value) OVER k) / stddev_samp(value) OVER k AS z FROM v WINDOW k AS (PARTITION BY city, feature))"


def zs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zscores(X.values(spark, sf_dir))


def zvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = zs(spark, sf_dir).groupBy("city", "cell_id").agg(F.sort_array(F.collect_list(F.struct("idx", "z"))).alias("t"))
    return x.select("city", "cell_id", F.transform("t", lambda e: e["z"]).alias("z"))


@query(f"WITH {Z_SQL} SELECT city, cell_id, feature, round(z, 6) AS z FROM z")
def zscore(spark, sf_dir):
    return zs(spark, sf_dir).select("city", "cell_id", "feature", *r6("z"))


@query(f"WITH {Z_SQL} SELECT a.city, a.idx AS i, b.idx AS j, round(sum(a.z * b.z) / (count(*) - 1), 6) AS cov FROM z a JOIN z b ON a.city = b.city AND a.cell_id = b.cell_id AND a.idx <= b.idx GROUP BY ALL")
def cov_matrix(spark, sf_dir):
    return stats.covariance(zvectors(spark, sf_dir), 64).withColumn("cov", F.round("cov", 6))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT city, feature, round(coalesce(corr(value, dist_km), 0), 6) AS r FROM v GROUP BY ALL")
def pearson_long(spark, sf_dir):
    return X.values(spark, sf_dir).groupBy("city", "feature").agg(F.round(stats.pearson("value", "dist_km"), 6).alias("r"))


@query(f"""WITH {Z_SQL}, w AS (SELECT city, cell_id, max(z) FILTER (WHERE idx = 0) AS a, max(z) FILTER (WHERE idx = 1) AS b FROM z GROUP BY ALL), c AS (SELECT city, sum(a * b) / (count(*) - 1) AS rho FROM w GROUP BY 1)
SELECT city, cell_id, round(CASE WHEN rho >= 0 THEN a + b ELSE a - b END / sqrt(2), 6) AS d1, round(CASE WHEN rho >= 0 THEN a - b ELSE a + b END / sqrt(2), 6) AS d2 FROM w JOIN c USING (city)""")
def pca2_scores(spark, sf_dir):
    x = zvectors(spark, sf_dir).withColumn("z", F.slice("z", 1, 2))
    s = stats.scores(x, stats.pca(x, 2))
    return s.select("city", "cell_id", F.round(F.get("score", F.lit(0)), 6).alias("d1"), F.round(F.get("score", F.lit(1)), 6).alias("d2"))


@query()
def pca_full(spark, sf_dir):
    return stats.pca(zvectors(spark, sf_dir), 64).select("city", "component", *r6("eigenvalue", "share"))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT city, cell_id, feature, round(percent_rank() OVER (PARTITION BY city, feature ORDER BY value), 6) AS rank FROM v")
def percent_rank_scale(spark, sf_dir):
    return stats.percent_rank(X.values(spark, sf_dir)).select("city", "cell_id", "feature", *r6("rank"))


@query(f"WITH v AS ({X.VALUES_SQL}), q AS (SELECT city, feature, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM v GROUP BY ALL) SELECT city, cell_id, feature, round((least(greatest(value, lo), hi) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS scaled FROM v JOIN q USING (city, feature)")
def winsor_scale(spark, sf_dir):
    return stats.winsorised(X.values(spark, sf_dir)).select("city", "cell_id", "feature", *r6("scaled"))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT city, feature, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM v GROUP BY ALL")
def legend_range(spark, sf_dir):
    return stats.legend_range(X.values(spark, sf_dir)).select("city", "feature", *r6("low", "high"))


@query(f"""WITH p AS ({X.points_sql()}), m AS (SELECT city, quantile_cont(lon, 0.5) AS mlon, quantile_cont(lat, 0.5) AS mlat FROM p GROUP BY 1), d AS (SELECT p.*, sqrt(pow((lon - mlon) * cos(radians(mlat)), 2) + pow(lat - mlat, 2)) AS d FROM p JOIN m USING (city)), c AS (SELECT city, 2.5e0 * quantile_cont(d, 0.95) AS cut FROM d GROUP BY 1)
SELECT city, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM d JOIN c USING (city) WHERE d <= cut GROUP BY 1""")
def robust_extent(spark, sf_dir):
    return grid.robust_extent(X.points(spark, sf_dir)).select("city", *r6("min_lon", "max_lon", "min_lat", "max_lat"))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT city, cell_id, feature, round(CASE WHEN idx % 2 = 0 THEN ln(1 + abs(value)) ELSE abs(value) END, 6) AS value FROM v")
def log_densities(spark, sf_dir):
    kinds = features(spark).select("feature", F.when(F.col("idx") % 2 == 0, "density").otherwise("fraction").alias("kind"))
    return stats.log_densities(X.values(spark, sf_dir).withColumn("value", F.abs("value")), kinds).select("city", "cell_id", "feature", *r6("value"))


@query(f"""WITH {Z_SQL}, w AS (SELECT city, cell_id, max(z) FILTER (WHERE idx = 0) AS a, max(z) FILTER (WHERE idx = 1) AS b FROM z GROUP BY ALL), c AS (SELECT city, sum(a * b) / (count(*) - 1) AS rho FROM w GROUP BY 1)
SELECT city, cell_id, round(value, 6) AS value, 'Feature 3' AS label, 'fraction of land' AS unit FROM z WHERE idx = 3
UNION ALL SELECT city, cell_id, round(CASE WHEN rho >= 0 THEN a - b ELSE a + b END / sqrt(2), 6), 'd2 (PCA component 2)', 'score' FROM w JOIN c USING (city)""")
def map_values(spark, sf_dir):
    known = features(spark).select("feature", F.concat(F.lit("Feature "), "idx").alias("label"), F.when(F.col("idx") % 2 == 0, "density").otherwise("fraction").alias("kind"))
    x = zvectors(spark, sf_dir).withColumn("z", F.slice("z", 1, 2))
    both = clusters.map_values(X.values(spark, sf_dir), known, "f3").union(clusters.map_values(stats.scores(x, stats.pca(x, 2)), known, "pc2"))
    return both.withColumn("value", F.round("value", 6))


# ---- clusters ----

K = 3
FIRST_SQL = "x AS (SELECT label AS city, vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS v, 0.5e0 + (vec_id % 7) * 0.1e0 AS land_km2, ((vec_id * 37) % 1000) / 50e0 AS dist_km FROM embeddings), c0 AS (SELECT city, row_number() OVER (PARTITION BY city ORDER BY cell_id)::INT - 1 AS label, v AS c FROM x QUALIFY label < 3)"


def step_sql(i: int) -> str:
    return f"""a{i} AS (SELECT x.*, label, list_sum(list_transform(list_zip(v, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM x JOIN c{i} USING (city) QUALIFY row_number() OVER (PARTITION BY x.city, cell_id ORDER BY d, label) = 1),
e{i} AS (SELECT city, label, i, avg(v[i]) AS m FROM (SELECT city, label, v, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY ALL), c{i + 1} AS (SELECT city, label, list(m ORDER BY i) AS c FROM e{i} GROUP BY ALL)"""


ASSIGNED_SQL = f"{FIRST_SQL}, {step_sql(0)}, {step_sql(1)}, {step_sql(2)}"


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.vectors(spark, sf_dir)
    n = F.row_number().over(grid.by_city("cell_id")) - 1
    return x.withColumn("label", n).filter(f"label < {K}").select("city", "label", F.col("v").alias("c"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.lloyd(X.vectors(spark, sf_dir), first_rows(spark, sf_dir), 2, lambda c: keep(c, "centroids"))


@query(f"WITH {FIRST_SQL}, {step_sql(0)} SELECT city, cell_id, label, round(d, 6) AS d FROM a0")
def kmeans_assign(spark, sf_dir):
    return kmeans.assign(X.vectors(spark, sf_dir), first_rows(spark, sf_dir)).select("city", "cell_id", "label", *r6("d"))


@query(f"WITH {ASSIGNED_SQL} SELECT city, cell_id, label, round(d, 6) AS d FROM a2")
def kmeans_lloyd2(spark, sf_dir):
    return assigned(spark, sf_dir).select("city", "cell_id", "label", *r6("d"))


PROFILE_SQL = f"{ASSIGNED_SQL}, {Z_SQL}, pr AS (SELECT a2.city, label, feature, idx, grp, avg(z) AS mean_z FROM z JOIN a2 USING (city, cell_id) GROUP BY ALL)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.profile(zs(spark, sf_dir), assigned(spark, sf_dir))


def features(spark: SparkSession) -> DataFrame:
    return spark.range(64).selectExpr("cast(id as int) idx", "concat('f', id) feature", "concat('g', id div 8) grp")


@query(f"WITH {PROFILE_SQL} SELECT city, label, feature, round(mean_z, 6) AS mean_z FROM pr")
def cluster_profile(spark, sf_dir):
    return profiles(spark, sf_dir).select("city", "label", "feature", *r6("mean_z"))


@query(f"WITH {ASSIGNED_SQL}, s AS (SELECT city, label, count(*) AS n, sum(land_km2) AS land_km2, avg(dist_km) AS mean_dist FROM a2 GROUP BY ALL) SELECT city, label, n, round(land_km2, 6) AS land_km2, round(mean_dist, 6) AS mean_dist, row_number() OVER (PARTITION BY city ORDER BY s.mean_dist, label)::INT AS rank FROM s")
def relabel(spark, sf_dir):
    return clusters.relabel(assigned(spark, sf_dir)).select("city", "label", "n", *r6("land_km2", "mean_dist"), "rank")


@query(f"""WITH {PROFILE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY city, label ORDER BY mean_z DESC, idx) AS u, row_number() OVER (PARTITION BY city, label ORDER BY mean_z, idx DESC) AS w FROM pr)
SELECT city, label, feature, round(mean_z, 6) AS mean_z, 'high' AS side, u::INT AS place FROM k WHERE u <= 4 AND k.mean_z > 0.25 UNION ALL SELECT city, label, feature, round(mean_z, 6), 'low', w::INT FROM k WHERE w <= 3 AND k.mean_z < -0.25""")
def highlights(spark, sf_dir):
    return clusters.highlights(profiles(spark, sf_dir), features(spark)).withColumn("mean_z", F.round("mean_z", 6))


#: Features two by two: the components of two standardised features are their sum and difference.
PAIRS_SQL = f"""{Z_SQL}, w AS (SELECT city * 100 + idx // 2 AS city, cell_id, max(z) FILTER (WHERE idx % 2 = 0) AS a, max(z) FILTER (WHERE idx % 2 = 1) AS b FROM z GROUP BY ALL), c AS (SELECT city, sum(a * b) / (count(*) - 1) AS rho FROM w GROUP BY 1),
d AS (SELECT w.*, CASE WHEN rho >= 0 THEN a + b ELSE a - b END AS d1, CASE WHEN rho >= 0 THEN a - b ELSE a + b END AS d2 FROM w JOIN c USING (city))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors z of features two by two, each two of a city as a city of its own."""
    x = zs(spark, sf_dir).select((F.col("city") * 100 + F.expr("idx div 2")).alias("city"), "cell_id", (F.col("idx") % 2).alias("idx"), "z")
    x = x.groupBy("city", "cell_id").agg(F.sort_array(F.collect_list(F.struct("idx", "z"))).alias("t"))
    return x.select("city", "cell_id", F.transform("t", lambda e: e["z"]).alias("z"))


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT city, 1 AS component, corr(a, d1) AS f0, corr(b, d1) AS f1 FROM d GROUP BY 1 UNION ALL SELECT city, 2, corr(a, d2), corr(b, d2) FROM d GROUP BY 1),
l AS (SELECT city, component, 'f0' AS feature, 0 AS idx, f0 AS r FROM r UNION ALL SELECT city, component, 'f1', 1, f1 FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY city, component ORDER BY round(r, 6) DESC, idx) AS u, row_number() OVER (PARTITION BY city, component ORDER BY round(r, 6), idx DESC) AS w FROM l)
SELECT city, component, feature, round(k.r, 6) AS r, 'top' AS side, u::INT AS place FROM k UNION ALL SELECT city, component, feature, round(k.r, 6), 'bottom', w::INT FROM k""")
def pc_correlates(spark, sf_dir):
    """Features that correlate most and least with both components, from eigenvalues and loadings alone."""
    known = features(spark).filter("idx < 2")
    r = stats.component_correlations(stats.pca(pairs(spark, sf_dir), 2), known).withColumn("r", F.round("r", 6))
    return clusters.pc_correlates(r)


@query(f"WITH {Z_SQL} SELECT a.city, a.idx AS i, b.idx AS j, round(sum(a.z * b.z) / (count(*) - 1), 6) AS cov FROM z a JOIN z b ON a.city = b.city AND a.cell_id = b.cell_id AND a.idx <= b.idx GROUP BY ALL")
def pca_rebuilt(spark, sf_dir):
    """All 64 components of every city, multiplied out: the covariance matrix again."""
    return stats.rebuilt(stats.pca(zvectors(spark, sf_dir), 64, 1.0)).select("city", "i", "j", *r6("cov"))


TERMS = {"A": [(1.0, "g0"), (1.5, ("f1", "f9"))], "B": [(0.9, ("f3",)), (-0.8, "g2")], "C": [(2.0, ("f60", "missing"))], "D": [(1.0, ("missing",))]}


@query(f"""WITH {PROFILE_SQL}, t(archetype, place, term, weight, g, k) AS (VALUES ('A', 0, 0, 1.0e0, 'g0', NULL), ('A', 0, 1, 1.5e0, NULL, 'f1'), ('A', 0, 1, 1.5e0, NULL, 'f9'), ('B', 1, 0, 0.9e0, NULL, 'f3'), ('B', 1, 1, -0.8e0, 'g2', NULL), ('C', 2, 0, 2e0, NULL, 'f60'), ('C', 2, 0, 2e0, NULL, 'missing'), ('D', 3, 0, 1e0, NULL, 'missing')),
m AS (SELECT city, label, archetype, term, weight, avg(mean_z) AS m FROM pr JOIN t ON pr.grp = t.g OR pr.feature = t.k GROUP BY ALL), s AS (SELECT city, label, archetype, sum(weight * m) AS score FROM m GROUP BY ALL), e AS (SELECT DISTINCT city, label, archetype FROM pr CROSS JOIN t)
SELECT city, label, archetype, round(coalesce(score, 0), 6) AS score FROM e LEFT JOIN s USING (city, label, archetype)""")
def archetype_scores(spark, sf_dir):
    x = clusters.archetype_scores(profiles(spark, sf_dir), features(spark), clusters.archetype_terms(spark, TERMS))
    return x.select("city", "label", "archetype", *r6("score"))


@query()
def named_clusters(spark, sf_dir):
    """Names by rank: ties, boroughs and own names go by distance to the centre."""
    own = spark.createDataFrame([(0, 1, "Mine")], "city int, label int, name string")
    x = assigned(spark, sf_dir)
    ranked = x.drop("d").join(clusters.relabel(x).select("city", "label", "rank"), ["city", "label"]).withColumn("label", F.col("rank"))
    found = clusters.archetype_scores(clusters.profile(zs(spark, sf_dir), ranked), features(spark), clusters.archetype_terms(spark, TERMS))
    return clusters.name_clusters(found, own).select("city", F.col("label").alias("rank"), "name")


@query(f"WITH {Z_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY city, cell_id ORDER BY abs(z) DESC, idx) AS place FROM z) SELECT city, cell_id, place::INT AS place, feature, round(k.z, 6) AS z FROM k WHERE place <= 4")
def top_cell_features(spark, sf_dir):
    return clusters.top_features(zs(spark, sf_dir)).withColumn("z", F.round("z", 6))


@query(f"WITH {ASSIGNED_SQL} SELECT city, label, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY city), 6) AS percent, round(avg(dist_km) * 0.621371e0, 6) AS miles FROM a2 GROUP BY city, label")
def cluster_share(spark, sf_dir):
    return clusters.cluster_share(assigned(spark, sf_dir)).select("city", "label", "n", *r6("percent", "miles"))


#: Every third feature is 0 in most cells, and so is dropped in small cities.
SPARSE_SQL = "CASE WHEN idx % 3 = 0 AND cell_id % 20 <> 0 THEN 0e0 ELSE value END"


@query(f"""WITH v AS (SELECT *, {SPARSE_SQL} AS rare FROM ({X.VALUES_SQL})), k AS (SELECT city, feature FROM v GROUP BY ALL HAVING count(*) FILTER (WHERE rare <> 0) >= greatest(5, 0.02e0 * count(*))), d AS (SELECT city, count(*) AS dims FROM k GROUP BY 1)
SELECT city, count(DISTINCT cell_id) AS cells, round(sum(land_km2) FILTER (WHERE idx = 0), 6) AS land_km2, any_value(dims) AS dims, 2 AS components, 1e0 AS explained FROM v JOIN d USING (city) GROUP BY 1""")
def city_summary(spark, sf_dir):
    """Totals of each city, with the number of its features that aren't sparse, and components of its first two features
    (two are the least kept, and explain these)."""
    x = zvectors(spark, sf_dir).withColumn("z", F.slice("z", 1, 2))
    used = grid.sparse_features(X.values(spark, sf_dir).withColumn("value", F.expr(SPARSE_SQL))).filter("kept")
    s = clusters.city_summary(X.vectors(spark, sf_dir), stats.pca(x, 2), used)
    return s.select("city", "cells", *r6("land_km2"), "dims", "components", *r6("explained"))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT DISTINCT feature, idx FROM v WHERE feature NOT IN ('f1', 'f2') AND grp <> 'g7'")
def enabled_features(spark, sf_dir):
    """Features in use without two keys and a group."""
    used = X.values(spark, sf_dir).select("feature", "idx", "grp").distinct()
    disabled = used.filter("feature in ('f1', 'f2') or grp = 'g7'").select("feature")
    return clusters.enabled_features(used, disabled).select("feature", "idx")


@query("""SELECT label AS city, 0 AS line, '{"city":' || label || ',"cells":' || count(*) || '}' AS document FROM embeddings GROUP BY label UNION ALL SELECT label, 1, '{"city":' || label || ',"cell_id":' || vec_id || '}' FROM embeddings""")
def city_documents(spark, sf_dir):
    x = X.vectors(spark, sf_dir)
    return clusters.city_documents(x.groupBy("city").agg(F.count("*").alias("cells")), x.select("city", "cell_id"))


@query(f"""WITH v AS (SELECT city, cell_id, idx, feature, {SPARSE_SQL} AS value FROM ({X.VALUES_SQL})), k AS (SELECT city, feature FROM v GROUP BY ALL HAVING count(*) FILTER (WHERE value <> 0) >= greatest(5, 0.02e0 * count(*)))
SELECT city, cell_id, feature, row_number() OVER (PARTITION BY city, cell_id ORDER BY idx)::INT AS place, round(v.value, 6) AS value FROM v JOIN k USING (city, feature)""")
def documents_back(spark, sf_dir):
    """Every city's document, written and read again: cells with the values of the features that its head lists."""
    known = features(spark).withColumns({"label": F.col("feature"), "kind": F.lit("density")})
    x = X.vectors(spark, sf_dir)
    cells = x.select("city", "cell_id", *(F.expr(SPARSE_SQL.replace("idx", str(i)).replace("value", f"v[{i}]")).alias(f"f{i}") for i in range(64)))
    kept = grid.sparse_features(grid.long_form(cells, ["city", "cell_id"], [f"f{i}" for i in range(64)])).filter("kept").select("city", "feature")
    place = {"lon": F.lit(0.0), "lat": F.lit(0.0), "land_km2": F.lit(1.0), "dist_km": F.lit(0.0), "p": F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))), "n": F.array(F.lit(1))}
    heads = cells.select("city").distinct().select("city", F.col("city").alias("slug"), F.lit("2026-01-01").alias("generated"))
    path = f"{new_folder(spark, 'documents')}/cities"
    documents.write_documents(documents.document_lines(heads, cells.withColumns(place), kept, known), path)
    back = documents.read_documents(spark, path).join(documents.read_heads(spark, path).select("city", "features"), "city")
    named = back.select(F.col("city").cast("int").alias("city"), F.col("id").cast("long").alias("cell_id"), F.posexplode(F.arrays_zip("features", "v")).alias("place", "e"))
    return named.select("city", "cell_id", F.col("e.features.key").alias("feature"), (F.col("place") + 1).alias("place"), F.round("e.v", 6).alias("value"))


@query(f"WITH v AS ({X.VALUES_SQL}) SELECT grp, count(DISTINCT feature) FILTER (WHERE feature NOT IN ('f1', 'f2', 'f63')) AS enabled, count(DISTINCT feature) AS total FROM v GROUP BY 1")
def group_counts(spark, sf_dir):
    used = X.values(spark, sf_dir).select("feature", "grp").distinct()
    return clusters.group_counts(used, ["f1", "f2", "f63"])


@query("""SELECT label AS city, vec_id AS cell_id, '{"type":"Feature","id":' || vec_id || ',"geometry":{"type":"Polygon","coordinates":[[[' || vec_id || ',' || (vec_id + 1) || '],[' || (vec_id + 1) || ',' || vec_id || '],[' || (vec_id + 1) || ',' || (vec_id + 1) || '],[' || vec_id || ',' || (vec_id + 1) || ']]]}}' AS feature FROM embeddings""")
def cells_geojson(spark, sf_dir):
    n = F.col("cell_id")
    point = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    return clusters.geojson(X.vectors(spark, sf_dir).withColumn("p", F.array(point(n, n + 1), point(n + 1, n), point(n + 1, n + 1))))


@query()
def sweep(spark, sf_dir):
    """k-means of every city for several k, seeds, sets of features and shares of variance."""
    some = tuple(range(8, 40))
    settings = [cities.SweepSetting(k, s, f, v) for k in (2, 5, 12) for s, f, v in ((42, (), 0.86), (1, (), 0.86), (42, some, 0.86), (42, (), 0.5))]
    known = features(spark).withColumn("kind", F.lit("score"))
    return cities.sweep(X.values(spark, sf_dir).select("city", "cell_id", "feature", "value"), known, settings).groupBy("city", "param_id").agg(F.countDistinct("label").alias("clusters"), F.round(F.max("inertia"), 6).alias("inertia"))
