"""Cluster profiles, ranks, highlights, names and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import ARCHETYPES
from ..functions.geo import KM_TO_MILES


def relabel(assigned: DataFrame) -> DataFrame:
    """(city, label, rank, n, land_km2, mean_dist): rank 1 is the most central; empty labels have no row."""
    x = assigned.groupBy("city", "label").agg(F.count("*").alias("n"), F.sum("land_km2").alias("land_km2"), F.avg("dist_km").alias("mean_dist"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy("mean_dist", "label")))


def profile(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(city, label, feature, mean_z) from (city, cell_id, feature, z) and (city, cell_id, label)."""
    return z.join(labels.select("city", "cell_id", "label"), ["city", "cell_id"]).groupBy("city", "label", "feature").agg(F.avg("z").alias("mean_z"))


def highlights(profiles: DataFrame, features: DataFrame, top: int = 4, low: int = 3, cut: float = 0.25) -> DataFrame:
    """The most and least marked features of each cluster (features: feature, idx). Ties go by feature order on the high
    side and against it on the low side, which is the same order read from its end."""
    x = profiles.join(F.broadcast(features.select("feature", "idx")), "feature")  # one row a feature
    by = Window.partitionBy("city", "label")
    x = x.withColumns({"up": F.row_number().over(by.orderBy(F.desc("mean_z"), "idx")), "down": F.row_number().over(by.orderBy("mean_z", F.desc("idx")))})
    high = x.filter((F.col("up") <= top) & (F.col("mean_z") > cut)).select("city", "label", "feature", "mean_z", F.lit("high").alias("side"), F.col("up").alias("place"))
    return high.union(x.filter((F.col("down") <= low) & (F.col("mean_z") < -cut)).select("city", "label", "feature", "mean_z", F.lit("low"), "down"))


def pc_correlates(correlations: DataFrame, n: int = 5) -> DataFrame:
    """Top and bottom n features by correlation with each component (city, component, feature, idx, r); ties as of
    ``highlights``."""
    by = Window.partitionBy("city", "component")
    x = correlations.withColumns({"up": F.row_number().over(by.orderBy(F.desc("r"), "idx")), "down": F.row_number().over(by.orderBy("r", F.desc("idx")))})
    top = x.filter(F.col("up") <= n).select("city", "component", "feature", "r", F.lit("top").alias("side"), F.col("up").alias("place"))
    return top.union(x.filter(F.col("down") <= n).select("city", "component", "feature", "r", F.lit("bottom"), "down"))


def archetype_terms(spark: SparkSession, archetypes: dict | None = None) -> DataFrame:
    """(archetype, place, term, weight, grp, key): one row per key of a term, or per group."""
    rows = []
    for place, (name, terms) in enumerate((archetypes or ARCHETYPES).items()):
        for t, (weight, what) in enumerate(terms):
            rows += [(name, place, t, weight, what, None)] if isinstance(what, str) else [(name, place, t, weight, None, k) for k in what]
    return spark.createDataFrame(rows, "archetype string, place int, term int, weight double, grp string, key string")


def archetype_scores(profiles: DataFrame, features: DataFrame, terms: DataFrame) -> DataFrame:
    """(city, label, archetype, place, score): weighted means over the features in use; an empty mean is 0."""
    x = profiles.join(F.broadcast(features.select("feature", "grp")), "feature")  # one row a feature
    t = F.broadcast(terms.select("archetype", "place", "term", "weight", F.col("grp").alias("tgrp"), "key"))
    by_key = x.join(t.filter("key is not null"), F.col("feature") == F.col("key"))
    by_grp = x.join(t.filter("key is null"), F.col("grp") == F.col("tgrp"))
    cols = ["city", "label", "archetype", "place", "term", "weight", "mean_z"]
    means = by_key.select(*cols).union(by_grp.select(*cols)).groupBy(*cols[:-1]).agg(F.avg("mean_z").alias("m"))
    found = means.groupBy("city", "label", "archetype", "place").agg(F.sum(F.col("weight") * F.col("m")).alias("found"))
    every = profiles.select("city", "label").distinct().join(F.broadcast(terms.select("archetype", "place").distinct()))  # ten archetypes
    return every.join(found, ["city", "label", "archetype", "place"], "left").select("city", "label", "archetype", "place", F.coalesce("found", F.lit(0.0)).alias("score"))


def name_clusters(scored: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(city, label, name): the best pair of cluster and archetype first, each used once; the rest
    are called Borough n. overrides (city, label, name) win."""
    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        names: dict = {}
        used: set[str] = set()
        for row in frame.sort_values(["score", "label", "place"], ascending=[False, True, True]).itertuples():
            if row.label not in names and row.archetype not in used:
                names[row.label] = row.archetype
                used.add(row.archetype)
        labels = sorted(frame.label.unique())
        return pd.DataFrame({"city": frame.city.iloc[0], "label": labels, "name": [names.get(v, f"Borough {i + 1}") for i, v in enumerate(labels)]})

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    out = scored.groupBy("city").applyInPandas(greedy, f"city {kinds['city']}, label {kinds['label']}, name string")
    if overrides is None:
        return out
    return out.join(overrides.withColumnRenamed("name", "own"), ["city", "label"], "left").select("city", "label", F.coalesce("own", "name").alias("name"))


def top_features(z: DataFrame, n: int = 4) -> DataFrame:
    """(city, cell_id, place, feature, z): the n features farthest from 0; a row's features are one small array."""
    x = z.groupBy("city", "cell_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("z")).alias("k"), "idx", "feature", "z"))), 1, n).alias("top"))
    return x.select("city", "cell_id", F.posexplode("top").alias("place", "t")).select("city", "cell_id", (F.col("place") + 1).alias("place"), "t.feature", "t.z")


def cluster_share(assigned: DataFrame) -> DataFrame:
    x = assigned.groupBy("city", "label").agg(F.count("*").alias("n"), F.avg("dist_km").alias("km"))
    return x.select("city", "label", "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("city"))).alias("percent"), (F.col("km") * KM_TO_MILES).alias("miles"))


def group_counts(features: DataFrame, disabled: list[str]) -> DataFrame:
    return features.groupBy("grp").agg(F.count_if(~F.col("feature").isin(*disabled)).alias("enabled"), F.count("*").alias("total"))


def enabled_features(features: DataFrame, disabled: DataFrame) -> DataFrame:
    """Features that are not disabled (column feature); fewer than two are an error."""
    left = features.join(disabled, "feature", "left_anti")
    if left.limit(2).count() < 2:
        raise ValueError("fewer than two features are enabled")
    return left


def geojson(cells: DataFrame) -> DataFrame:
    """(city, cell_id, feature): a GeoJSON feature of each cell (p: array of lon, lat), its ring closed."""
    ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.array(q["lon"], q["lat"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select("city", "cell_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("cell_id").alias("id"), shape.alias("geometry"))).alias("feature"))


def map_values(cells: DataFrame, features: DataFrame, mode: str) -> DataFrame:
    """(city, cell_id, value, label, unit) for a map: of a feature (its key; cells: long rows city, cell_id, feature,
    value), or of the first or second component (pc1, pc2; cells: score, an array of the components)."""
    if mode in ("pc1", "pc2"):
        n = int(mode[2])
        x = cells.filter(F.size("score") >= n)
        return x.select("city", "cell_id", F.get("score", F.lit(n - 1)).alias("value"), F.lit(f"d{n} (PCA component {n})").alias("label"), F.lit("score").alias("unit"))
    one = features.filter(F.col("feature") == mode).select("feature", "label", F.when(F.col("kind") == "density", "per km²").otherwise("fraction of land").alias("unit"))
    return cells.filter(F.col("feature") == mode).join(F.broadcast(one), "feature").select("city", "cell_id", "value", "label", "unit")  # one row


def city_summary(cells: DataFrame, components: DataFrame, used: DataFrame) -> DataFrame:
    """(city, cells, land_km2, dims, components, explained) from cells (city, land_km2), components (city, component,
    share) and the features in use (city, feature), which dims counts."""
    x = cells.groupBy("city").agg(F.count("*").alias("cells"), F.sum("land_km2").alias("land_km2"))
    d = used.groupBy("city").agg(F.count("*").alias("dims"))
    c = components.groupBy("city").agg(F.count("*").alias("components"), F.sum("share").alias("explained"))
    return x.join(d, "city").join(c, "city").select("city", "cells", "land_km2", "dims", "components", "explained")


def city_documents(header: DataFrame, cells: DataFrame) -> DataFrame:
    """(city, line, document): the header as line 0 of a city, then one JSON line per cell, so no city is gathered in
    a row. Write it with ``repartition("city").sortWithinPartitions("city", "line")`` and ``partitionBy("city")``."""
    top = header.select("city", F.lit(0).alias("line"), F.to_json(F.struct(*header.columns)).alias("document"))
    return top.union(cells.select("city", F.lit(1), F.to_json(F.struct(*cells.columns))))
