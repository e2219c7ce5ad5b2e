"""Statistics of cell vectors by city, in long form (city, cell_id, feature, value) unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import places, quantiles

MIN_STD = 1e-9


def log_densities(values: DataFrame, features: DataFrame) -> DataFrame:
    """log1p of density features (features: feature, kind; one row a feature)."""
    x = values.join(F.broadcast(features.select("feature", "kind")), "feature")
    return x.withColumn("value", F.when(F.col("kind") == "density", F.log1p("value")).otherwise(F.col("value"))).drop("kind")


def zscores(values: DataFrame) -> DataFrame:
    """Column z; features of a city without spread go. Moments are summed before the shuffle and come back as one row per (city, feature)."""
    m = values.groupBy("city", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).filter(F.col("std") > MIN_STD)
    return values.join(m, ["city", "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def pearson(x: str, y: str) -> F.Column:
    c = F.corr(x, y)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def gram(vectors: DataFrame, width: int, column: str = "z") -> DataFrame:
    """(city, i, j, s) with s = sum of z_i z_j for i <= j: partial sums per task, then one aggregation."""
    upper = np.triu_indices(width)

    def partial(frames):
        sums: dict[object, np.ndarray] = {}
        for frame in frames:
            for city, rows in frame.groupby("city", sort=False):
                z = np.stack(rows[column].to_numpy())
                sums[city] = sums.get(city, 0) + z.T @ z
        for city, s in sums.items():
            yield pd.DataFrame({"city": city, "i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "s": s[upper]})

    kind = vectors.schema["city"].dataType.simpleString()
    return vectors.select("city", column).mapInPandas(partial, f"city {kind}, i int, j int, s double").groupBy("city", "i", "j").agg(F.sum("s").alias("s"))


def covariance(vectors: DataFrame, width: int, column: str = "z") -> DataFrame:
    n = vectors.groupBy("city").agg(F.count("*").alias("n"))
    return gram(vectors, width, column).join(F.broadcast(n), "city").select("city", "i", "j", (F.col("s") / (F.col("n") - 1)).alias("cov"))  # n: one row per city


def eigen(cov: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (none below 0), loadings by column with the largest entry positive, and the
    number of components that reach the target share, 2 at least. Entries are as large as each other where they differ
    by no more than rounding of ``cov`` turns their column, which grows as the next eigenvalue comes near."""
    w, v = np.linalg.eigh(cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    size = np.abs(v)
    apart = np.concatenate(([np.inf], -np.diff(w), [np.inf]))
    near = np.maximum(np.minimum(apart[1:], apart[:-1]), 1e-300)
    lead = np.argmax(size >= size.max(axis=0) - np.minimum(1e-12 + 1e-12 * w[0] / near, 1e-3), axis=0)
    v = v * np.where(v[lead, np.arange(v.shape[1])] < 0, -1.0, 1.0)
    total = w.sum()
    share = np.cumsum(w) / total if total > 0 else np.ones(len(w))
    return w, v, min(len(w), max(2, int(np.searchsorted(share, target - 1e-15) + 1)))


def pca(vectors: DataFrame, width: int, target: float = 0.86, column: str = "z") -> DataFrame:
    """(city, component, eigenvalue, share, loading): the components kept, from a width x width matrix per city."""
    cov = covariance(vectors, width, column)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((width, width))
        m[frame.i, frame.j] = frame["cov"]
        m[frame.j, frame.i] = frame["cov"]
        w, v, k = eigen(m, target)
        total = w.sum() or 1.0
        return pd.DataFrame({"city": frame.city.iloc[0], "component": np.arange(1, k + 1, dtype=np.int32), "eigenvalue": w[:k], "share": w[:k] / total, "loading": list(v[:, :k].T)})

    kind = vectors.schema["city"].dataType.simpleString()
    return cov.groupBy("city").applyInPandas(solve, f"city {kind}, component int, eigenvalue double, share double, loading array<double>")


def setting_loadings(cov: DataFrame, width: int, settings: list[tuple[int, list[int], float]]) -> DataFrame:
    """(city, param_id, components, loading) of settings (param_id, places of the features in use, share of variance): the
    components of a part of each city's one covariance matrix. loading has a row for each feature, zeros for those not
    in use; rows of the cities aren't read again."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((width, width))
        m[frame.i, frame.j] = frame["cov"]
        m[frame.j, frame.i] = frame["cov"]
        out = []
        for param, used, target in settings:
            _, v, k = eigen(m[np.ix_(used, used)], target)
            whole = np.zeros((width, k))
            whole[used] = v[:, :k]
            out.append((frame.city.iloc[0], param, k, list(whole)))
        return pd.DataFrame(out, columns=["city", "param_id", "components", "loading"])

    kind = cov.schema["city"].dataType.simpleString()
    return cov.groupBy("city").applyInPandas(solve, f"city {kind}, param_id int, components int, loading array<array<double>>")


def component_correlations(components: DataFrame, features: DataFrame) -> DataFrame:
    """(city, component, feature, idx, r): correlation of each standardised feature (feature, idx) with the scores of each
    component. For scores z . l that is l_j times the root of the component's eigenvalue, so no row is read; features
    without spread have loadings of 0."""
    x = components.select("city", "component", "eigenvalue", F.posexplode("loading").alias("idx", "l"))
    r = x.select("city", "component", "idx", (F.col("l") * F.sqrt("eigenvalue")).alias("r"))
    return r.join(F.broadcast(features.select("feature", "idx")), "idx").select("city", "component", "feature", "idx", "r")  # a row a feature


def rebuilt(components: DataFrame) -> DataFrame:
    """(city, i, j, cov), i <= j, from eigenvalues and loadings: the covariance matrix again where all components are kept."""
    x = components.select("city", "eigenvalue", "loading", F.posexplode("loading").alias("i", "a"))
    x = x.select("city", "eigenvalue", "i", "a", F.posexplode("loading").alias("j", "b")).filter("i <= j")
    return x.groupBy("city", "i", "j").agg(F.sum(F.col("eigenvalue") * F.col("a") * F.col("b")).alias("cov"))


def scores(vectors: DataFrame, components: DataFrame, column: str = "z") -> DataFrame:
    """vectors with ``score``: an array of one number per component of the city."""
    c = components.groupBy("city").agg(F.transform(F.sort_array(F.collect_list(F.struct("component", "loading"))), lambda t: t["loading"]).alias("loadings"))  # one row per city
    dot = lambda loading: F.aggregate(F.zip_with(F.col(column), loading, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return vectors.join(F.broadcast(c), "city").withColumn("score", F.transform("loadings", dot)).drop("loadings")


def percent_rank(values: DataFrame) -> DataFrame:
    """values with ``rank``: the share of the other values of the city and feature that are smaller. Equal values are counted
    together before they are put in order, so many of them cost no more than few."""
    x = places(values.groupBy("city", "feature", "value").agg(F.count("*").alias("_m")), ["city", "feature"], ["value"], "_m")
    rank = x.select("city", "feature", "value", F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0).alias("rank"))
    return values.join(rank, ["city", "feature", "value"]).select(*values.columns, "rank")


def winsorised(values: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """value clipped to two quantiles and scaled to 0..1, by city and feature."""
    x = values.join(quantiles(values, ["city", "feature"], {"lo": low, "hi": high}), ["city", "feature"])
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return x.withColumn("scaled", (F.least(F.greatest("value", "lo"), F.col("hi")) - F.col("lo")) / width).drop("lo", "hi")


def legend_range(values: DataFrame) -> DataFrame:
    return quantiles(values, ["city", "feature"], {"low": 0.02, "high": 0.98})
