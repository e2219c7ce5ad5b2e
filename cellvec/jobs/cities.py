"""The two workloads: raw points and polygons to cell vectors, and cell vectors to clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import AREA_CLASSES, KEYS
from ..functions.geo import unproject
from ..operators import clusters, grid, kmeans, overlay, stats
from ..sources import documents
from ..tables import keep


@dataclass(frozen=True)
class RunConfig:
    k: int = 5
    log: bool = True
    var_target: float = 0.86
    seed: int = 42
    restarts: int = 12
    max_iter: int = 200
    disabled: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 2 <= self.k <= 12 or not 0.5 <= self.var_target <= 0.99:
            raise ValueError("k must be 2 to 12 and var_target 0.5 to 0.99")


#: Metres of the squares by which a city's land is measured.
COARSE = 5_000.0


def city_bounds(areas: DataFrame, water: DataFrame) -> DataFrame:
    """(city, lon0, lat0, minx .. maxy, land_m2) of areas (city, lon0, lat0, parts in metres): the boundary's bounds,
    and its area without the water (city, rings)."""
    x = overlay.measures(areas).select("city", "lon0", "lat0", "minx", "miny", "maxx", "maxy")
    coarse = x.select("city", F.lit(COARSE).alias("r"), F.lit(COARSE).alias("w"), F.col("minx").alias("minx0"), F.col("miny").alias("miny0"))
    land = overlay.cell_land(boundary_rings(areas), water, coarse, "square").groupBy("city").agg(F.sum("area").alias("land_m2"))
    return x.join(land, "city")


def boundary_rings(areas: DataFrame) -> DataFrame:
    return areas.select("city", F.explode("parts").alias("rings"))


def build_cells(points: DataFrame, land_use: DataFrame, areas: DataFrame, water: DataFrame, bounds: DataFrame, centers: DataFrame, target_cells: int = 800) -> DataFrame:
    """Cell vectors of all cities. areas: (city, lon0, lat0, parts: the boundary's polygons in metres); water: (city,
    rings) to be taken off it; bounds: as of ``city_bounds``, one row per city, best read from a written table;
    land_use: (city, cls, rings in metres); centers: (city, clon, clat). Points outside the boundary don't count, in
    whichever cell they are."""
    params = grid.grid_params(bounds, target_cells)
    land = keep(overlay.cell_land(boundary_rings(areas), water, params), "land")
    points = overlay.inside(grid.to_cells(points, params), overlay.measures(areas).select("city", "parts", "minx", "miny", "maxx", "maxy"))
    cells = grid.with_centres(land.select("city", "row", "col", "area"), params)
    counts = grid.cell_activity(points).filter(grid.ACTIVE)  # cells without points aren't active
    x = grid.with_land(cells, overlay.overlay_land(land_use, land, params)).join(counts, grid.CELL)
    x = x.join(F.broadcast(centers), "city").withColumns(grid.place_columns(F.col("clon"), F.col("clat")))  # one row per city
    return x.select("city", "cell_id", "lon", "lat", grid.corners().alias("p"), F.round("land_km2", 4).alias("land_km2"), "dist_km", F.array(*KEYS).alias("n"), *grid.densities(), *(f"{c}_frac" for c in AREA_CLASSES))


def write_run(spark: SparkSession, cells: DataFrame, registry: DataFrame, areas: DataFrame, bounds: DataFrame, path: str, generated: str, target_cells: int = 800) -> DataFrame:
    """Write a document for each city of ``cells`` (from ``build_cells``; a written table) under path/cities, and the index
    of all documents there, which is returned, under path/index. registry: (slug: the city, name, country,
    osm_relation, center, center_label); areas and bounds as of ``build_cells``."""
    features = feature_table(spark)
    keys = [r.feature for r in features.orderBy("idx").select("feature").collect()]  # the catalogue's rows
    kept = grid.sparse_features(grid.long_form(cells, ["city", "cell_id"], keys)).filter("kept").select("city", "feature")
    lonlat = lambda p: F.struct(*(c.alias(n) for c, n in zip(unproject(p["x"], p["y"], F.col("lon0"), F.col("lat0")), ("lon", "lat"), strict=True)))
    shape = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lonlat)))
    r = grid.grid_params(bounds, target_cells).select("city", F.round("r").cast("long").alias("hex_radius_m"))
    groups = F.array(*(F.lit(g) for g in dict.fromkeys(row.grp for row in features.orderBy("idx").collect())))
    heads = registry.withColumn("city", F.col("slug")).join(r, "city").join(areas.select("city", documents.geometry(shape).alias("boundary")), "city")
    heads = heads.withColumns({"generated": F.lit(generated), "groups": groups}).select("city", "slug", "name", "country", "osm_relation", "center", "center_label", "hex_radius_m", "generated", "groups", "boundary")
    at = F.split("cell_id", "_")
    cells = cells.withColumns({"row": at[0].cast("int"), "col": at[1].cast("int")})
    documents.write_documents(documents.document_lines(heads, cells, kept, features, ("row", "col")), f"{path}/cities")
    index = documents.read_index(spark, f"{path}/cities", registry)
    documents.write_index(index, f"{path}/index")
    return index


@dataclass(frozen=True)
class Clustering:
    """What a run finds, as tables: z (city, cell_id, feature, idx, z) of the features in use; components (city, component,
    eigenvalue, share, loading); scores (city, cell_id, v); ranked (city, cell_id, label: the rank); totals (city, label,
    rank, n, land_km2, mean_dist); profile (city, label, feature, mean_z); names (city, label, name)."""

    features: DataFrame
    z: DataFrame
    components: DataFrame
    scores: DataFrame
    ranked: DataFrame
    totals: DataFrame
    profile: DataFrame
    names: DataFrame

    def named(self) -> DataFrame:
        """(city, cell_id, rank, name)."""
        return self.ranked.join(self.names, ["city", "label"]).select("city", "cell_id", F.col("label").alias("rank"), "name")

    def highlights(self) -> DataFrame:
        return clusters.highlights(self.profile, self.features)

    def correlates(self) -> DataFrame:
        """Top and bottom features of the first two components, among the features in use in each city."""
        r = stats.component_correlations(self.components.filter("component <= 2"), self.features)
        return clusters.pc_correlates(r.join(self.profile.select("city", "feature").distinct(), ["city", "feature"], "left_semi"))


def standardised(values: DataFrame, features: DataFrame, log: bool = True) -> tuple[DataFrame, DataFrame]:
    """z of long rows (city, cell_id, feature, value), by city, after logarithms of densities; and the same as vectors
    (city, cell_id, z) over all ``features`` (feature, idx, kind) in the order of idx, 0 where a feature has no spread."""
    z = stats.zscores(stats.log_densities(values, features) if log else values)
    order = [r.feature for r in features.orderBy("idx").select("feature").collect()]  # the catalogue's rows
    x = z.groupBy("city", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("m"))
    at = lambda n: F.coalesce(F.try_element_at(F.col("m"), n), F.lit(0.0))
    return z, x.select("city", "cell_id", F.transform(F.array(*map(F.lit, order)), at).alias("z"))


def run_clustering(spark: SparkSession, cells: DataFrame, features: DataFrame, config: RunConfig, names: DataFrame | None = None) -> Clustering:
    """Cells (city, cell_id, land_km2, dist_km and feature columns) through logarithms, z-scores, components, k-means,
    ranks and names; names (city, label: the rank, name) win over archetypes. A feature that is sparse or constant in a
    city has z = 0 there, which leaves distances as without it. ``cells`` is read several times and should be a
    written table."""
    used = clusters.enabled_features(features, spark.createDataFrame([(d,) for d in config.disabled], "feature string"))
    keys = [r.feature for r in used.orderBy("idx").select("feature").collect()]  # the catalogue's rows
    place = {k: i for i, k in enumerate(keys)}
    used = used.drop("idx").join(F.broadcast(spark.createDataFrame(list(place.items()), "feature string, idx int")), "feature")
    values = grid.long_form(cells, ["city", "cell_id"], keys)
    kept = grid.sparse_features(values).filter("kept").select("city", "feature")
    z, vectors = standardised(values.join(kept, ["city", "feature"]), used, config.log)
    vectors = keep(vectors, "vectors")
    components = keep(stats.pca(vectors, len(keys), config.var_target), "components")
    scores = keep(stats.scores(vectors, components).select("city", "cell_id", F.col("score").alias("v")), "scores")
    labels = kmeans.cluster_all(scores, [kmeans.Setting(0, config.k, config.seed, config.restarts, config.max_iter)]).select("city", "cell_id", "label")
    labels = keep(labels, "labels")
    totals = clusters.relabel(cells.select("city", "cell_id", "land_km2", "dist_km").join(labels, ["city", "cell_id"]))
    ranked = labels.join(totals.select("city", "label", "rank"), ["city", "label"]).select("city", "cell_id", F.col("rank").alias("label"))
    z = z.join(F.broadcast(used.select("feature", "idx")), "feature")  # a row a feature
    profile = clusters.profile(z, ranked)
    found = clusters.archetype_scores(profile, features, clusters.archetype_terms(spark))
    return Clustering(used, z, components, scores, ranked, totals, profile, clusters.name_clusters(found, names))


def cluster_cities(spark: SparkSession, cells: DataFrame, features: DataFrame, config: RunConfig, names: DataFrame | None = None) -> DataFrame:
    """(city, cell_id, rank, name), as of ``run_clustering``."""
    return run_clustering(spark, cells, features, config, names).named()


@dataclass(frozen=True)
class SweepSetting:
    k: int
    seed: int = 42
    features: tuple[int, ...] = field(default=())  # places; none: all
    var_target: float = 0.86
    restarts: int = 12
    max_iter: int = 200


def sweep(values: DataFrame, features: DataFrame, settings: list[SweepSetting], log: bool = True) -> DataFrame:
    """(city, param_id, cell_id, label, inertia) of long rows (city, cell_id, feature, value) for every setting. Logarithms,
    z-scores and one covariance matrix a city serve all settings: each takes the components of its features' part of it,
    and clusters the same rows through its own loadings."""
    width = features.count()
    _, vectors = standardised(values, features, log)
    vectors = keep(vectors, "vectors")
    every = list(range(width))
    own = [(i, list(s.features) or every, s.var_target) for i, s in enumerate(settings)]
    loadings = keep(stats.setting_loadings(stats.covariance(vectors, width), width, own), "loadings")
    return kmeans.cluster_all(vectors, [kmeans.Setting(i, s.k, s.seed, s.restarts, s.max_iter) for i, s in enumerate(settings)], "z", loadings)


def feature_table(spark: SparkSession) -> DataFrame:
    """(idx, feature, label, grp, kind, source) of the 54 features."""
    from ..catalog import POINT_FEATURES

    rows = [(i, f.key, f.label, f.grp, "density", f.source) for i, f in enumerate(POINT_FEATURES)]
    rows += [(len(KEYS) + i, f"{c}_frac", c, g, "fraction", None) for i, (c, g) in enumerate(AREA_CLASSES.items())]
    return spark.createDataFrame(rows, "idx int, feature string, label string, grp string, kind string, source string")
