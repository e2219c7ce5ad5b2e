"""k-means over Spark against one array, and a sweep against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellvec.jobs import cities
from cellvec.operators import clusters, kmeans, stats


def clouds(seed, n, width, groups):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)) + 4 * rng.normal(size=(groups, width))[rng.integers(0, groups, n)]


def test_same_as_one_array(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "CHUNK", 16)
    data = {"a": clouds(1, 130, 3, 4), "b": clouds(2, 57, 3, 3), "one": clouds(3, 1, 3, 1), "two": clouds(4, 2, 3, 1), "same": np.repeat(clouds(5, 3, 3, 1), 9, axis=0), "wider": clouds(6, 40, 5, 2)}
    rows = [(c, f"{i:04d}", [float(v) for v in x]) for c, xs in data.items() for i, x in enumerate(xs)]
    settings = [kmeans.Setting(0, 4, 42, 3, 200), kmeans.Setting(5, 6, 1, 2, 2)]
    df = spark.createDataFrame(rows, "city string, cell_id string, v array<double>").repartition(5)
    got = kmeans.cluster_all(df, settings).toPandas().sort_values(["city", "param_id", "cell_id"])
    assert len(got) == 2 * len(rows)
    for (city, param), g in got.groupby(["city", "param_id"]):
        s = next(s for s in settings if s.param_id == param)
        labels, _, inertia = kmeans.kmeans_array(data[city], s.k, s.restarts, s.max_iter, s.seed)
        assert g.inertia.iloc[0] == pytest.approx(inertia, abs=1e-9) and g.inertia.nunique() == 1
        assert g.label.tolist() == labels.tolist(), (city, param)
    monkeypatch.setattr(kmeans, "MOST_BYTES", 1)  # a city at a time
    some = F.col("city").isin("same", "two")
    again = kmeans.cluster_all(df.filter(some), settings[1:]).toPandas().sort_values(["city", "cell_id"])
    want = got[got.city.isin(["same", "two"]) & (got.param_id == 5)].sort_values(["city", "cell_id"])
    assert again[["city", "cell_id", "label"]].values.tolist() == want[["city", "cell_id", "label"]].values.tolist()


def test_passes_leave_sums_and_not_rows(spark, monkeypatch):
    """A draw leaves a row for each run, a step one for each task and setting, however many rows a chunk has; and few steps
    over several chunks equal one array's."""
    monkeypatch.setattr(kmeans, "CHUNK", 16)
    left, over = [], kmeans.Rows.over

    def counted(self, runs, f, schema, *rest, **more):
        out = over(self, runs, f, schema, *rest, **more)
        left.append((f.__name__, len(runs), out.count()))
        return out

    data = {1: clouds(1, 70, 3, 4), 2: np.repeat(clouds(5, 3, 3, 1), 9, axis=0)}
    df = spark.createDataFrame([(c, i, [float(v) for v in x]) for c, xs in data.items() for i, x in enumerate(xs)], "city int, cell_id int, v array<double>")
    monkeypatch.setattr(kmeans.Rows, "over", counted)
    got = kmeans.cluster_all(df, [kmeans.Setting(0, 4, 42, 3, 3)]).toPandas().sort_values(["city", "cell_id"])
    for city, g in got.groupby("city"):
        labels, _, inertia = kmeans.kmeans_array(data[city], 4, 3, 3)
        assert g.label.tolist() == labels.tolist() and g.inertia.iloc[0] == pytest.approx(inertia, abs=1e-9)
    assert {n for n, _, _ in left} >= {"distant", "partial"}
    assert all(rows == runs for name, runs, rows in left if name == "distant")
    assert all(rows <= 2 * 8 for name, _, rows in left if name == "partial")


def test_nearest_of_many_runs_with_ties():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(50, 7)), 1e8 + rng.normal(size=(9, 7))])
    c = np.stack([x[rng.integers(0, 59, 5)] for _ in range(6)])
    c[:, 3] = c[:, 1]  # alike: the lower label
    c[0, 2] = np.nextafter(c[0, 1], np.inf)
    want = np.stack([kmeans.distances(x, own).argmin(axis=1) for own in c], axis=1)
    assert (kmeans.nearest(x, c) == want).all()
    assert (kmeans.nearest_distances(x, c) == np.stack([kmeans.distances(x, own).min(axis=1) for own in c], axis=1)).all()


def test_no_rows(spark):
    df = spark.createDataFrame([], "city string, cell_id string, v array<double>")
    assert kmeans.cluster_all(df, [kmeans.Setting(0, 3)]).count() == 0


def test_sweep_as_a_plain_loop(spark):
    """Densities take logarithms; a constant feature has no part; each setting has its own features and components."""
    data = {c: np.abs(clouds(c, 60, 6, 3)) for c in (1, 2)}
    data[2][:, 4] = 1.5
    rows = [(c, i, f"f{j}", float(v)) for c, xs in data.items() for i, x in enumerate(xs) for j, v in enumerate(x)]
    values = spark.createDataFrame(rows, "city int, cell_id int, feature string, value double").repartition(3)
    known = spark.createDataFrame([(f"f{j}", j, "density" if j < 3 else "fraction") for j in range(6)], "feature string, idx int, kind string")
    settings = [cities.SweepSetting(3, 42, (), 0.86, 4), cities.SweepSetting(2, 5, (0, 2, 4, 5), 0.5, 4), cities.SweepSetting(4, 42, (1, 2, 3), 0.99, 2)]
    got = cities.sweep(values, known, settings).toPandas()
    for (city, param), g in got.groupby(["city", "param_id"]):
        s, x = settings[param], data[city].copy()
        x[:, :3] = np.log1p(x[:, :3])
        spread = x.std(axis=0, ddof=1)
        z = np.where(spread > 1e-9, (x - x.mean(axis=0)) / np.where(spread > 1e-9, spread, 1), 0)[:, list(s.features) or range(6)]
        _, v, k = stats.eigen(np.cov(z.T), s.var_target)
        labels, _, inertia = kmeans.kmeans_array(z @ v[:, :k], s.k, s.restarts, s.max_iter, s.seed)
        assert g.inertia.iloc[0] == pytest.approx(inertia, rel=1e-9)
        assert g.sort_values("cell_id").label.tolist() == labels.tolist()


def test_correlations_are_those_of_the_scores(spark):
    x = clouds(9, 80, 5, 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    z[:, 3] = 0  # dropped
    df = spark.createDataFrame([("c", i, [float(v) for v in r]) for i, r in enumerate(z)], "city string, cell_id int, z array<double>")
    parts = stats.pca(df, 5)
    known = spark.createDataFrame([(f"f{j}", j) for j in range(5)], "feature string, idx int")
    got = {(r.component, r.idx): r.r for r in stats.component_correlations(parts, known).collect()}
    scores = np.array([r.score for r in stats.scores(df, parts).orderBy("cell_id").collect()])
    for c in range(scores.shape[1]):
        for j in range(5):
            assert got[c + 1, j] == pytest.approx(0 if j == 3 else np.corrcoef(z[:, j], scores[:, c])[0, 1], abs=1e-9)


def test_low_ties_go_against_feature_order(spark):
    rows = [("c", 1, f"f{j}", v) for j, v in enumerate([-1.0, -1.0, -1.0, -1.0, 2.0, 2.0])]
    known = spark.createDataFrame([(f"f{j}", j) for j in range(6)], "feature string, idx int")
    got = clusters.highlights(spark.createDataFrame(rows, "city string, label int, feature string, mean_z double"), known)
    assert [r.feature for r in got.filter(F.col("side") == "low").orderBy("place").collect()] == ["f3", "f2", "f1"]
    assert [r.feature for r in got.filter(F.col("side") == "high").orderBy("place").collect()] == ["f4", "f5"]


def test_signs_of_nearly_equal_entries():
    """Rounding of the covariance turns components of near eigenvalues; the first of entries that are equal but for that
    is positive."""
    for rho in (1.5e-4, -1.5e-4, 0.3):
        for a, b in ((0.0, 4e-15), (4e-15, 0.0)):
            _, v, _ = stats.eigen(np.array([[1 + a, rho], [rho, 1 + b]]), 1.0)
            assert (v[0] > 0).all() and v[1] == pytest.approx(np.array([1, -1]) * np.sign(rho) * 0.5**0.5, abs=1e-6)
