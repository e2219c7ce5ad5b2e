"""Readers of registries, points, elements and boundaries, and the source filters over elements.

T3 points: city, source, osm_type, osm_id, lat, lon, tags. T4 elements: city, type, id, tags, geometry, members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import has_tag, tag, tag_in

POINT = "struct<lat: double, lon: double>"
REGISTRY = "slug: string, name: string, country: string, osm_relation: bigint, center: array<double>, center_label: string"
ELEMENT = f"type: string, id: bigint, tags: map<string, string>, geometry: array<{POINT}>, members: array<struct<type: string, role: string, geometry: array<{POINT}>>>"
#: Tag columns of each point source, in the order of its files.
SOURCE_TAGS = {"amenity": ["amenity"], "shop": ["shop"], "tlo": ["tourism", "leisure", "office"], "transit": ["railway", "highway", "station"], "trees": [], "streets": ["highway"], "buildings": ["building", "building:levels", "height"]}
#: Values that the sources ask for.
AMENITIES = [
    "arts_centre", "atm", "bank", "bar", "bicycle_parking", "bicycle_rental", "biergarten", "cafe",
    "car_wash", "casino", "charging_station", "childcare", "cinema", "clinic", "college", "community_centre",
    "coworking_space", "dentist", "doctors", "events_venue", "fast_food", "fire_station", "fuel", "hospital",
    "ice_cream", "kindergarten", "library", "marketplace", "music_venue", "nightclub", "parking", "pharmacy",
    "place_of_worship", "police", "post_office", "pub", "restaurant", "school", "social_facility",
    "stripclub", "theatre", "university", "veterinary",
]
HIGHWAYS = [
    "cycleway", "footway", "living_street", "motorway", "path", "pedestrian", "primary", "residential",
    "secondary", "service", "steps", "tertiary", "trunk", "unclassified",
]
RAILWAYS = ["station", "halt", "tram_stop", "subway_entrance"]
#: Tag values that the land-use source asks for.
LAND_USE_TAGS = {
    "landuse": ["residential", "commercial", "retail", "industrial", "grass", "forest", "meadow", "cemetery", "farmland", "recreation_ground", "orchard", "vineyard", "allotments", "village_green", "railway", "military", "brownfield", "construction"],
    "leisure": ["park", "garden", "golf_course", "nature_reserve", "pitch"],
    "natural": ["wood", "water", "scrub", "wetland", "beach", "heath", "grassland", "bay", "sand"],
    "aeroway": ["aerodrome"],
}


def parse_registry(raw: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """Cities of registries (body: a JSON list); a list of slugs keeps these only."""
    x = raw.select(F.explode(F.from_json("body", f"array<struct<{REGISTRY}>>")).alias("c")).select("c.*")
    return x.filter(F.col("slug").isin(*slugs)) if slugs else x


def read_registry(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    return parse_registry(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"), slugs)


def parse_points(lines: DataFrame, source: str) -> DataFrame:
    """Points of headerless TSV lines (city, value): lat, lon and the source's tags; rows without both numbers go."""
    names = SOURCE_TAGS[source]
    fields = F.from_csv("value", "lat string, lon string" + "".join(f", `{c}` string" for c in names), {"sep": "\t", "quote": '"', "escape": '"'})
    x = lines.filter("value != ''").select("city", fields.alias("f")).select("city", "f.*")
    tags = F.map_filter(F.create_map(*[v for c in names for v in (F.lit(c), F.col(f"`{c}`"))]), lambda _, v: F.coalesce(v != "", F.lit(False))) if names else F.expr("cast(map() as map<string, string>)")
    return x.select("city", F.lit(source).alias("source"), F.lit(None).cast("string").alias("osm_type"), F.lit(None).cast("long").alias("osm_id"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), tags.alias("tags")).filter("lat is not null and lon is not null")


def read_points(spark: SparkSession, path: str, city: str, source: str) -> DataFrame:
    return parse_points(spark.read.text(path).withColumn("city", F.lit(city)), source)


def parse_elements(raw: DataFrame) -> DataFrame:
    """Elements of answers (city, body): one row per element of the JSON's list."""
    parsed = F.from_json("body", f"struct<elements: array<struct<{ELEMENT}>>>")
    return raw.select("city", F.explode(parsed.getField("elements")).alias("e")).select("city", "e.*")


def parse_boundary(raw: DataFrame) -> DataFrame:
    """(city, polys) from GeoJSON text: parts, rings, points."""
    ring = "array<array<array<double>>>"
    one, many = F.from_json("geojson", f"type string, coordinates {ring}"), F.from_json("geojson", f"type string, coordinates array<{ring}>")
    polys = F.when(F.get_json_object("geojson", "$.type") == "Polygon", F.array(one["coordinates"])).otherwise(many["coordinates"])
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    return raw.select("city", F.transform(polys, lambda part: F.transform(part, lambda r: F.transform(r, point))).alias("polys"))


def source_filters() -> dict[str, Column]:
    """The seven point sources as predicates over elements."""
    kind = F.col("type")
    return {
        "amenity": tag_in("amenity", AMENITIES),
        "shop": has_tag("shop"),
        "tlo": has_tag("tourism") | has_tag("leisure") | has_tag("office"),
        "transit": tag_in("railway", RAILWAYS) | ((kind == "node") & F.coalesce(tag("highway") == "bus_stop", F.lit(False))),
        "trees": (kind == "node") & F.coalesce(tag("natural") == "tree", F.lit(False)),
        "streets": (kind == "way") & tag_in("highway", HIGHWAYS),
        "buildings": (kind == "way") & has_tag("building"),
    }


def land_use_elements(elements: DataFrame) -> DataFrame:
    """Elements with a tag value that the land-use source asks for (nodes give no polygon later on)."""
    asked = F.lit(False)
    for key, values in LAND_USE_TAGS.items():
        asked = asked | tag_in(key, values)
    return elements.filter(asked)


def distinct_elements(elements: DataFrame) -> DataFrame:
    """One row per (city, type, id): copies of an element are equal."""
    return elements.dropDuplicates(["city", "type", "id"])


def representative(elements: DataFrame) -> DataFrame:
    """Elements with lat and lon: the middle of the bounding box of their points."""
    own = F.coalesce("geometry", F.flatten(F.transform("members", lambda m: F.coalesce(m["geometry"], F.expr(f"cast(array() as array<{POINT}>)")))))
    x = elements.withColumn("_all", own)
    middle = lambda f: (F.array_min(F.transform("_all", lambda p: p[f])) + F.array_max(F.transform("_all", lambda p: p[f]))) / 2
    return x.withColumns({"lat": middle("lat"), "lon": middle("lon")}).drop("_all").filter("lat is not null")


def points_of(elements: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Point rows of every source that is not skipped; an element enters each source once."""
    x = representative(distinct_elements(elements))
    hits = F.array_compact(F.array(*(F.when(p, F.lit(s)) for s, p in source_filters().items() if s not in skip)))
    return x.select("city", F.explode(hits).alias("source"), F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "lat", "lon", "tags")
