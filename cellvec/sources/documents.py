"""Documents of cities: a valid JSON document for each, in a folder of its own, and an index of those that are there.

A document is written as lines: its head (what is known of the city, its features, its boundary), a line for each cell,
and its end. Lines are dealt by ranges of city and cell, so no city is gathered in a row or a task; a city's files
in the order of their names, one behind the other, are its document. Writing some cities leaves the others' folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "id string, c array<double>, p array<array<double>>, land_km2 double, dist_km double, v array<double>, n array<bigint>"
HEAD = "slug string, name string, country string, generated string, features array<struct<key: string, label: string, `group`: string, kind: string>>"


def used_features(kept: DataFrame, features: DataFrame) -> DataFrame:
    """(city, used): the kept features (city, feature) of each city with what is known of them (idx, feature, label, grp,
    kind), in order."""
    x = kept.join(F.broadcast(features.select("idx", "feature", "label", "grp", "kind")), "feature")  # a row a feature
    return x.groupBy("city").agg(F.sort_array(F.collect_list(F.struct("idx", "feature", "label", "grp", "kind"))).alias("used"))


def geometry(parts: Column) -> Column:
    """GeoJSON of a boundary (polygons of rings of lon, lat), rings closed."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, lambda p: F.transform(p, ring)).alias("coordinates"))


def document_lines(heads: DataFrame, cells: DataFrame, kept: DataFrame, features: DataFrame, order: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(city, part, *order, text): the lines of each city's document, in order of all but the last column.

    heads: a row a city, (city, and what the head holds, in its order); cells: (city, cell_id, lon, lat, p, land_km2,
    dist_km, n: counts, and a column for each feature); kept: (city, feature), to which features, v and n are cut. Cities
    without cells have no document."""
    keys = [r.feature for r in features.orderBy("idx").select("feature").collect()]  # the catalogue's rows
    used = used_features(kept, features)
    x = cells.join(used, "city")
    values = F.array(*(F.col(k).cast("double") for k in keys))
    point = lambda q: F.array(q["lon"], q["lat"])
    cell = F.struct(
        F.col("cell_id").cast("string").alias("id"), F.array("lon", "lat").alias("c"), F.transform("p", point).alias("p"), "land_km2", "dist_km",
        F.transform("used", lambda f: F.get(values, f["idx"])).alias("v"), F.transform(F.filter("used", lambda f: f["kind"] == "density"), lambda f: F.get(F.col("n"), f["idx"])).alias("n"),
    )
    first = cells.groupBy("city").agg(F.min(F.struct(*order)).alias("_first"))  # a row a city
    lines = x.join(first, "city").select("city", F.lit(1).alias("part"), *order, F.concat(F.when(F.col("_first") == F.struct(*order), "").otherwise(","), F.to_json(cell)).alias("text"))
    none = [F.lit(None).cast(cells.schema[o].dataType).alias(o) for o in order]
    own = F.transform("used", lambda f: F.struct(f["feature"].alias("key"), f["label"].alias("label"), f["grp"].alias("group"), f["kind"].alias("kind")))
    known = [c for c in heads.columns if c not in ("city", "boundary")]
    head = F.struct(*known, own.alias("features"), *(["boundary"] if "boundary" in heads.columns else []))
    top = heads.join(first, "city").join(used, "city", "left").withColumn("used", F.coalesce("used", F.array().cast(used.schema["used"].dataType)))
    top = top.select("city", F.to_json(head).alias("text"))
    begin = top.select("city", F.lit(0).alias("part"), *none, F.concat(F.expr("left(text, length(text) - 1)"), F.lit(',"cells":[')).alias("text"))
    return begin.unionByName(lines).unionByName(top.select("city", F.lit(2).alias("part"), *none, F.lit("]}").alias("text")))


def write_documents(lines: DataFrame, path: str) -> None:
    """Write the documents of ``document_lines``; folders of other cities stay as they are."""
    by = [c for c in lines.columns if c != "text"]
    x = lines.repartitionByRange(*by).sortWithinPartitions(*by).select("city", "text")
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, city string").text(path).filter("value <> ']}'").withColumn("is_head", F.col("value").endswith(',"cells":['))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(city, id, c, p, land_km2, dist_km, v, n) of all documents' cells."""
    x = read_lines(spark, path).filter("not is_head")
    return x.select("city", F.from_json(F.regexp_replace("value", "^,", ""), CELL).alias("c")).select("city", "c.*")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """(city, slug, name, country, generated, features) of all documents."""
    x = read_lines(spark, path).filter("is_head")
    return x.select("city", F.from_json(F.concat("value", F.lit("]}")), HEAD).alias("h")).select("city", "h.*")


def read_index(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """(slug, name, country, center, cells, generated) of the registry's cities that have a document, from what is there."""
    x = read_lines(spark, path).groupBy("city").agg(F.count_if(~F.col("is_head")).alias("cells"))
    x = x.join(read_heads(spark, path).select("city", "generated"), "city")
    known = registry.select("slug", "name", F.coalesce("country", F.lit("")).alias("country"), "center")
    return known.join(x, known["slug"].cast("string") == x["city"]).drop("city")


def write_index(index: DataFrame, path: str) -> None:
    """The index as one JSON list, a line a city."""
    rows = index.orderBy("slug").agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct(*index.columns)))), ",\n"), F.lit("\n]")).alias("value"))  # a row a city
    rows.coalesce(1).write.mode("overwrite").text(path)
