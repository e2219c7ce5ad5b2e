"""Registered city queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cellvec.jobs.queries import QUERIES, SQL

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "nation", "part", "supplier"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert len(a)
    columns = sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=False, rtol=0, atol=1e-6)


def test_cells_and_clusters_end_to_end(spark):
    """Cells lie in boundaries that lack a quarter; every cell has a rank and a name, ranks go by distance."""
    x = QUERIES["city_cells"](spark, SF).toPandas()
    assert len(x) > 100 and x.water_frac.between(0, 1).all() and (x.land_km2 > 0).all() and (x.p.str.len() == 6).all()
    y = QUERIES["city_clusters"](spark, SF).toPandas().merge(x[["city", "cell_id", "dist_km"]], on=["city", "cell_id"])
    assert len(y) == len(x)
    for _, c in y.groupby("city"):
        mean = c.groupby("rank").dist_km.mean()
        assert list(mean.index) == list(range(1, len(mean) + 1)) and mean.is_monotonic_increasing
        assert (c.groupby("rank").name.nunique() == 1).all() and c.name.nunique() == len(mean)


def test_names_by_rank(spark):
    """Greedy names against a plain loop: the best pairs first, ties by rank; own names win, the rest are boroughs."""
    got = {(r.city, r["rank"]): r["name"] for r in QUERIES["named_clusters"](spark, SF).collect()}
    scored = QUERIES["archetype_scores"](spark, SF).toPandas().merge(QUERIES["relabel"](spark, SF).toPandas()[["city", "label", "rank"]], on=["city", "label"])
    for city, c in scored.groupby("city"):
        left, used = {}, set()
        for r in c.sort_values(["score", "rank", "archetype"], ascending=[False, True, True]).itertuples():
            if r.rank not in left and r.archetype not in used:
                left[r.rank] = r.archetype
                used.add(r.archetype)
        for rank in c["rank"].unique():
            want = "Mine" if (city, rank) == (0, 1) else left.get(rank, f"Borough {rank}")
            assert got[city, rank] == want
